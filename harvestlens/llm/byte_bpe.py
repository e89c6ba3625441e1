"""Byte-level BPE over a global shuffle of distinct words.

A word is a stretch of text that begins at a space followed by something visible (or at the start of
the text). No match of the pre-tokenizer's pattern crosses such a place, because that space can only be
the optional first character of the next match. So a word holds whole matches, and encoding every
match of a word separately gives what encoding the text would.

1. Blocks of texts are split into words with positions. A block lists each of its words once, and
   the texts as numbers of these words; frequent words get small numbers. Both are dealt by block.
2. The words of all blocks are shuffled by word. Each distinct word is encoded once.
3. The ids travel back to their blocks, and positions put them in order.

The exchange by block is computed once and read by steps 2 and 3. Should Spark recompute a part of it
after a loss, the block has the same name only if it holds the same words in the same order; if the
input cannot be read in the same order again, step 3 stops with an error and gives no wrong ids.

Decoding looks the ids up in the table of token bytes (its size is that of the vocabulary file).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common

BLOCK_BYTES = 24 << 20
_UNSAFE = re.compile(r" (?:\s|\Z)")  # a space that does not start a word
_STARTS = re.compile(r"(?= \S)")
BLOCKS = "block string, shard int, numbers binary, lengths binary, words binary, doc_ids binary, counts binary"
_ARROW = pa.schema([("block", pa.string()), ("shard", pa.int32()),
                    *[(n, pa.binary()) for n in ("numbers", "lengths", "words", "doc_ids", "counts")]])
_IDS = pa.list_(pa.int32())


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids from a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def split_words(text: str) -> list[str]:
    """The words of a text, each but the first without its leading space."""
    if _UNSAFE.search(text) is None:
        return text.split(" ")
    first, *rest = _STARTS.split(text)
    return ([first] if not first.startswith(" ") or first[1:2].isspace() or len(first) < 2 else ["", first[1:]]) + [
        w[1:] for w in rest]


class Block:
    """Texts as numbers of distinct words."""

    def __init__(self, name: str, shards: int):
        self.name, self.shards, self.size = name, shards, 0
        following = count().__next__
        self.first, self.later = defaultdict(following), defaultdict(following)
        self.places: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []

    def add(self, doc_id: int | None, text: str) -> None:
        words = split_words(text)
        numbers = np.fromiter(map(self.later.__getitem__, words[1:]), np.int64, len(words) - 1)
        self.places.append(np.concatenate([[self.first[words[0]]], numbers]))
        self.doc_ids.append(doc_id)
        self.size += len(text)

    def rows(self) -> pa.RecordBatch:
        words = [b""] * (len(self.first) + len(self.later))
        for w, i in self.first.items():
            words[i] = w.encode()
        for w, i in self.later.items():
            words[i] = b" " + w.encode()
        places = np.concatenate(self.places)
        by_use = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
        number = np.empty(len(words), np.int64)
        number[by_use] = np.arange(len(words))
        ids = pa.array(self.doc_ids, pa.int64())
        ordered = [words[i] for i in by_use]
        name = f"{self.name}-{zlib.crc32(bytes(1).join(ordered)):08x}"
        out = [{"block": name, "shard": -1, "numbers": common.pack(number[places]), "doc_ids": _ids_out(ids),
                "counts": common.pack(np.array([len(p) for p in self.places]))}]
        shard = np.fromiter((zlib.crc32(w) % self.shards for w in ordered), np.int64, len(ordered))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[s]:cuts[s + 1]]
            part = [ordered[i] for i in own]
            out.append({"block": name, "shard": int(s), "numbers": common.deltas(own),
                        "lengths": common.pack(np.array([len(w) for w in part])), "words": zip_bytes(b"".join(part))})
        return pa.RecordBatch.from_pylist(out, _ARROW)


def zip_bytes(x: bytes) -> bytes:
    import zstandard

    return zstandard.compress(x, 3)


def unzip_bytes(x: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(x)


def _ids_out(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
        out.write_batch(pa.record_batch([ids], ["doc_id"]))
    return sink.getvalue().to_pybytes()


def _ids_in(block: bytes) -> pa.Array:
    return pa.ipc.open_stream(block).read_all().column(0).combine_chunks()


def to_blocks(shards: int, block_bytes: int):
    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        block = Block(f"{task}-0", shards)
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                block.add(doc_id, text.as_py() or "")
                if block.size >= block_bytes:
                    yield block.rows()
                    made += 1
                    block = Block(f"{task}-{made}", shards)
        if block.doc_ids:
            yield block.rows()

    return build


def _words_only(rows: pa.Table) -> pa.Table:
    return rows.filter(pa.compute.greater_equal(rows["shard"], 0)).select(["shard", "block", "numbers", "lengths", "words"])


def encode_shard(pattern: str, ranks):
    """Encode each distinct word of a shard once and list the ids for every block that has it."""

    def run(rows: pa.Table) -> pa.Table:
        import tiktoken

        coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = {"block": [], "numbers": [], "lengths": [], "ids": []}
        for row in rows.to_pylist():
            joined, ends = unzip_bytes(row["words"]), np.cumsum(common.unpack(row["lengths"])).tolist()
            found, start = [], 0
            for end in ends:
                word = joined[start:end]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = coder.encode_ordinary(word.decode())
                found.append(ids)
                start = end
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            out["block"].append(row["block"])
            out["numbers"].append(row["numbers"])
            out["lengths"].append(common.pack(lengths))
            out["ids"].append(common.pack(np.fromiter((i for x in found for i in x), np.int64, int(lengths.sum()))))
        return pa.table(out, _SHARD)

    return run


_SHARD = pa.schema([("block", pa.string()), *[(n, pa.binary()) for n in ("numbers", "lengths", "ids")]])


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... of lengths[i] items, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def reassemble(ranks, columns: list[str]):
    """Put the ids of a block's words in the order of its texts."""

    def run(texts: pa.Table, shards: pa.Table) -> pa.Table:
        numbers, lengths, ids = (
            np.concatenate([np.zeros(0, np.uint64), *[read(x.as_py()) for x in shards.column(name)]]).astype(np.int64)
            for name, read in (("numbers", common.undeltas), ("lengths", common.unpack), ("ids", common.unpack)))
        if not len(numbers) or not np.array_equal(np.sort(numbers), np.arange(len(numbers))):
            raise RuntimeError("a block met the words of another reading of its texts; write the input as a table first")
        texts = texts.filter(pa.compute.less(texts["shard"], 0))
        order = np.argsort(numbers)
        lengths_by, starts_by = lengths[order], (np.cumsum(lengths) - lengths)[order]
        ids = ids.astype(np.int32)
        tokens = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for token, rank in ranks.value.items():
            tokens[rank] = token
        out = {c: [] for c in columns}
        doc_ids: list[pa.Array] = []
        for row in texts.to_pylist():
            places = common.unpack(row["numbers"]).astype(np.int64)
            start = 0
            doc_ids.append(_ids_in(row["doc_ids"]))
            for n in common.unpack(row["counts"]).tolist():
                own = places[start:start + n]
                start += n
                found = ids[_ragged(starts_by[own], lengths_by[own])]
                if "n_tokens" in out:
                    out["n_tokens"].append(len(found))
                if "ids" in out:
                    out["ids"].append(found)
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                if "decoded_sha256" in out:
                    out["decoded_sha256"].append(
                        hashlib.sha256(b"".join([tokens[i] for i in found.tolist()])).hexdigest())
        return pa.table([pa.chunked_array(doc_ids, pa.int64()), *[pa.array(out[c], ARROW[c]) for c in columns]],
                        ["doc_id", *columns])

    return run


ARROW = {"n_tokens": pa.int64(), "ids": _IDS, "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
SPARK = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, vocabulary: str, pattern: str, columns: tuple[str, ...] = ("ids",),
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token ids of the texts of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id (null stays null, repeated rows stay repeated) and ``columns``
    out of ids, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers) and
    decoded_sha256 (of the bytes that the ids decode to). A null or empty text has no ids; an empty
    table gives no rows. Strings of special tokens are ordinary text. The vocabulary is read on the
    driver and broadcast; its size does not depend on the documents.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = common.own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), common.whole_text().alias("text"))
    blocks = texts.mapInArrow(to_blocks(shards, block_bytes), BLOCKS)
    words = blocks.groupBy("block").applyInArrow(
        _words_only, "shard int, block string, numbers binary, lengths binary, words binary")
    ids = words.groupBy("shard").applyInArrow(
        encode_shard(pattern, ranks), "block string, numbers binary, lengths binary, ids binary")
    schema = ", ".join(["doc_id long", *[f"{c} {SPARK[c]}" for c in columns]])
    return (blocks.groupBy("block").cogroup(ids.groupBy("block"))
            .applyInArrow(reassemble(ranks, list(columns)), schema))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text that the ``ids`` of each row decode to; null ids count as none.

    Bytes that are not UTF-8 become replacement characters.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(vocabulary).items()})

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [b"".join([ranks.value[i] for i in ids or []]).decode("utf-8", "replace")
                     for ids in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return common.own_columns(encoded, "doc_id", "ids").mapInArrow(look_up, "doc_id long, text string")
