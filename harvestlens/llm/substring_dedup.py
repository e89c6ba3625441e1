"""Removal of repeated passages by fixed-block anchors.

A repeat of ``WINDOW`` words that starts anywhere holds a whole block of ``BLOCK`` words that begins at a
multiple of ``BLOCK`` in the document it repeats, because 2 * BLOCK - 1 <= WINDOW. So the index lists only the
non-overlapping blocks of every document, and is probed with every rolling window of ``BLOCK`` words.

1. Every chunk of documents sends its distinct block hashes to the range they lie in: which of them
   begin a block of the index, and which occur more than once. A hash that is in the index
   and occurs at two places is an anchor; the chunks that sent it are told.
2. Hits are extended: around an anchor a chunk takes all windows of ``WINDOW`` words that hold it, up to
   WINDOW - BLOCK words to either side. These windows go to the range of their own hash with the
   smallest document that holds them; neighbouring windows that repeat make up the maximal repeat.
3. Each chunk learns which of its windows also start in a smaller document of another chunk, finds those
   repeated inside the chunk itself, and removes every word covered by such a window.

Copies are collapsed in the chunk before anything is sent, so no list of partners or pairs is made. Block
hashes are short, an accident costs one more look; windows are equal when 96 bits of two hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common

WINDOW = 13
BLOCK = 7
CHUNK_BYTES = 12 << 20


def _parts(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes], common.Words, np.ndarray]]:
    """doc_ids, texts and words of a chunk, batch by batch, documents in ascending order."""
    table = table.sort_by("doc_id")
    ids, texts = table["doc_id"].to_numpy(), common.text_bytes(table["text"])
    for part in common.batches(texts):
        words = common.Words(texts[part])
        yield ids[part], texts[part], words, words.hashes()


def _blocks(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of BLOCK words, cut to ``bits``, and which begin a block of the index."""
    keys, aligned = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for _, _, words, hashes in _parts(table):
        runs, at = words.runs(hashes, BLOCK)
        keys.append(runs >> np.uint64(64 - bits))
        aligned.append((at - words.first[words.text[at]]) % BLOCK == 0)
    return np.concatenate(keys), np.concatenate(aligned)


def _cut(chunk: int, keys: np.ndarray, bits: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) for ascending keys of so many bits."""
    if not len(keys):
        return []
    shard = ((keys >> np.uint64(max(0, bits - 32))) * np.uint64(shards) >> np.uint64(min(bits, 32))).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


_PROBES = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary())])


def send_blocks(bits: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        keys, aligned = _blocks(table, bits)
        keys, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        flags = (np.bincount(place, aligned, minlength=len(keys)) > 0) + 2 * (counts > 1)
        return pa.Table.from_pylist(
            [{"shard": s, "chunk": chunk, "keys": common.deltas(keys[a:b]), "flags": common.pack(flags[a:b])}
             for s, a, b in _cut(chunk, keys, bits, shards)], _PROBES)

    return run


def find_anchors(table: pa.Table) -> pa.Table:
    """Of the hashes of a range, those of the index that occur again, for each chunk that has them."""
    keys = [common.undeltas(x.as_py()) for x in table["keys"]]
    flags = [common.unpack(x.as_py()).astype(np.uint8) for x in table["flags"]]
    every, place, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    joined = np.concatenate(flags)
    indexed = np.bincount(place, joined & 1, minlength=len(every)) > 0
    again = (counts > 1) | (np.bincount(place, joined >> 1, minlength=len(every)) > 0)
    anchor = (indexed & again)[place]
    out, start = {"chunk": [], "keys": []}, 0
    for chunk, own in zip(table["chunk"].to_pylist(), keys, strict=True):
        hit = anchor[start:start + len(own)]
        start += len(own)
        if hit.any():
            out["chunk"].append(chunk)
            out["keys"].append(common.deltas(own[hit]))
    return pa.table(out, pa.schema([("chunk", pa.int32()), ("keys", pa.binary())]))


def _received(table: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[common.undeltas(x.as_py()) for x in table["keys"]]]))


def _within(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


_WINDOWS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()),
                      ("base", pa.int64()), ("docs", pa.binary())])
WINDOWS = "shard int, chunk int, keys binary, checks binary, base long, docs binary"


def extend(bits: int, shards: int):
    """The windows around the anchors of a chunk, each with the smallest document that holds it."""

    def run(table: pa.Table, anchors: pa.Table) -> pa.Table:
        if not table.num_rows or not anchors.num_rows:
            return pa.Table.from_pylist([], _WINDOWS)
        held = _received(anchors)
        keys, checks, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for ids, _, words, hashes in _parts(table):
            runs, at = words.runs(hashes, BLOCK)
            hit = np.zeros(len(hashes) + 1, np.int64)
            hit[at[_within(runs >> np.uint64(64 - bits), held)] + 1] = 1
            upto = np.cumsum(hit)
            own, first = words.runs(hashes, WINDOW)
            near = upto[first + WINDOW - BLOCK + 1] > upto[first]  # an anchor begins inside the window and ends in it
            keys.append(own[near])
            checks.append((words.runs(words.hashes(1), WINDOW, 1)[0][near] >> np.uint64(32)).astype(np.uint32))
            docs.append(ids[words.text[first[near]]])
        keys, first = np.unique(np.concatenate(keys), return_index=True)  # documents ascend: the first is the smallest
        checks, docs = np.concatenate(checks)[first], np.concatenate(docs)[first]
        base = int(docs.min(initial=0))
        chunk = table["chunk"][0].as_py()
        return pa.Table.from_pylist(
            [{"shard": s, "chunk": chunk, "keys": common.deltas(keys[a:b]), "checks": checks[a:b].tobytes(), "base": base,
              "docs": common.pack(docs[a:b] - base)} for s, a, b in _cut(chunk, keys, 64, shards)], _WINDOWS)

    return run


def compare(table: pa.Table) -> pa.Table:
    """For each chunk, the windows of a range that also start in a smaller document of another chunk."""
    rows = table.select(["chunk", "keys", "checks", "base", "docs"]).to_pylist()
    keys = [common.undeltas(r["keys"]) for r in rows]
    docs = np.concatenate([common.unpack(r["docs"]).astype(np.int64) + r["base"] for r in rows])
    checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
    joined = np.concatenate(keys)
    order = np.lexsort((docs, checks, joined))
    same = (joined[order][1:] == joined[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.empty_like(docs)
    least[order] = np.repeat(docs[order][start], np.diff(np.append(start, len(docs))))
    smaller = least < docs
    out, at = {"chunk": [], "keys": []}, 0
    for row, own in zip(rows, keys, strict=True):
        hit = smaller[at:at + len(own)]
        at += len(own)
        if hit.any():
            out["chunk"].append(row["chunk"])
            out["keys"].append(common.deltas(own[hit]))
    return pa.table(out, pa.schema([("chunk", pa.int32()), ("keys", pa.binary())]))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def remove(table: pa.Table, repeated: pa.Table, text: bool) -> pa.Table:
    held = _received(repeated)
    every = [(ids[words.text[first]], own) for ids, _, words, hashes in _parts(table)
             for own, first in [words.runs(hashes, WINDOW)]]
    docs = np.concatenate([np.zeros(0, np.int64), *[d for d, _ in every]])
    keys = np.concatenate([np.zeros(0, np.uint64), *[k for _, k in every]])
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    gone = (docs > docs[first][place]) | _within(keys, held)  # documents ascend: the first is the smallest
    out, start = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}, 0
    for (ids, texts, words, hashes) in _parts(table):
        first = words.runs(hashes, WINDOW)[1]
        own = first[gone[start:start + len(first)]]
        start += len(first)
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, own, 1)
        np.add.at(cover, own + WINDOW, -1)
        keep = np.cumsum(cover)[:-1] == 0
        for i, doc_id in enumerate(ids.tolist()):
            mask = keep[words.first[i]:words.first[i + 1]]
            found = texts[i].split()
            if not mask.all():
                found = [w for w, k in zip(found, mask.tolist(), strict=True) if k]
            kept = b" ".join(found)
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(mask))
            out["n_removed"].append(len(mask) - len(found))
            out["kept"].append(kept.decode() if text else hashlib.sha256(kept).hexdigest())
    return pa.table(out, _RESULT)


def remove_repeats(docs: DataFrame, text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove the words of ``docs`` (doc_id, text) that are covered by a window starting in a smaller document.

    Returns one row per input row: doc_id, n_words, n_removed and kept_text (the kept words joined by one
    space) or, without ``text``, kept_sha256. Other columns are ignored. A null text has no words. A row with
    a null doc_id is neither searched nor changed. Rows that repeat a doc_id do not remove each other's
    words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = common.chunk_count(docs, "text", chunk_bytes)
    bits = min(62, (chunks * chunk_bytes // 4).bit_length() + 12)  # few hashes meet by accident
    texts = common.own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), common.whole_text().alias("text"))
    dealt = texts.filter("doc_id is not null").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text").groupBy("chunk")
    found = "chunk int, keys binary"
    anchors = (dealt.applyInArrow(send_blocks(bits, shards), "shard int, chunk int, keys binary, flags binary")
               .groupBy("shard").applyInArrow(find_anchors, found))
    repeated = (dealt.cogroup(anchors.groupBy("chunk")).applyInArrow(extend(bits, shards), WINDOWS)
                .groupBy("shard").applyInArrow(compare, found))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return remove(left, right, text)

    kept = dealt.cogroup(repeated.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept string")
    words = F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))
    whole = F.concat_ws(" ", words)
    alone = texts.filter("doc_id is null").select("doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias(
        "n_removed"), (whole if text else F.sha2(whole, 256)).alias("kept"))
    return kept.unionByName(alone).withColumnRenamed("kept", "kept_text" if text else "kept_sha256")
