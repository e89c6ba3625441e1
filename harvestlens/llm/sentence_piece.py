"""SentencePiece (BPE with byte fallback) by a table of the last token of every prefix.

Merging adjacent symbols by score gives every prefix of a text one encoding, and so one last token. A
sequence of tokens is the encoding of its text exactly if each neighbouring pair is: if encoding the two
tokens' joined text gives the two back. So, from left to right:

1. an automaton lists the pieces that end at a position;
2. of these, the one that fits the last token of the prefix before it is the last token here;
3. from the end, last tokens are followed backwards to the ids.

That is linear in the text, also for a text without any space. Whether two tokens fit is decided by
climbing the right edge of the first's merges and the left edge of the second's in order of score, until
a merge across the border would come first (they do not fit) or both are whole (they do).

No piece has a space mark after another character, so what lies between such places is encoded alone,
and each task remembers the encodings of the stretches it has seen (within a limit of characters).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common

SPACE = "▁"
REMEMBERED = 8 << 20  # characters of stretches a task remembers before it starts anew
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5  # kinds of pieces in a model file
UNKNOWN_TEXT = " ⁇ "  # what an unknown id decodes to where the model names nothing else
_NEVER = float("inf")


@dataclass
class Model:
    """What a model file says: pieces with scores and kinds, and how texts are prepared."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    byte_fallback: bool = False
    prefix: bool = True
    unknown_text: str = UNKNOWN_TEXT


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def read_model(path: str) -> Model:
    """Read a model file. Models that merge otherwise than by BPE, or change characters, are refused."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    pieces, trainer, normalizer = [], {}, {}
    for number, value in message:
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    model = Model(*map(list, zip(*pieces)), byte_fallback=bool(trainer.get(35, 0)), prefix=bool(normalizer.get(3, 1)),
                  unknown_text=trainer.get(44, UNKNOWN_TEXT.encode()).decode())
    refused = {
        "not BPE": trainer.get(3, 1) != 2, "changes characters": bool(normalizer.get(2, b"")),
        "removes white space": bool(normalizer.get(4, 1)), "keeps spaces": not normalizer.get(5, 1),
        "marks the ends of words": bool(trainer.get(24, 0)), "has pieces of its user": USER in model.kinds or UNUSED in model.kinds,
    }
    if any(refused.values()):
        raise ValueError(f"{path}: " + ", ".join(k for k, v in refused.items() if v))
    return model


def merge(symbols: list[str], rank: dict[str, float]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Merge by definition: the best-ranked neighbours first, the leftmost of equals. Also lists the merges."""
    symbols, done = list(symbols), []
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            return symbols, done
        i = best[1]
        done.append((symbols[i] + symbols[i + 1], symbols[i], symbols[i + 1]))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


class Encoder:
    """Tables made from the pieces; their size is that of the vocabulary."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.size = len(model.pieces)
        self.rank = {p: -s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        self.wide = self.size + 0x110000  # a character that is no piece has the number size + code point
        # One merge joins two symbols; which ones is fixed for every piece that merging reaches at all.
        parts, odd = {}, set()
        for piece in sorted(self.rank, key=len):
            whole, merges = merge(list(piece), self.rank)
            if len(whole) == 1:
                made = {m[0]: m for m in merges}
                parts[piece] = made[piece][1:] if merges else None
                if any(self.rank[m[0]] > self.rank[piece] for m in merges):
                    odd.add(piece)  # a part comes after the whole in rank: decided by definition
        self.parts, self.odd = parts, {self.number(p) for p in odd}
        self.edges = {self.number(p): (self._edge(p, 1), self._edge(p, 0)) for p in parts}
        self.joins = {}
        for piece, rank in self.rank.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if (k == 1 or a in parts) and (len(b) == 1 or b in parts):
                    self.joins[self.number(a) * self.wide + self.number(b)] = rank
        self.automaton = ahocorasick.Automaton()
        for piece in parts:
            self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        self.alone = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.alone else ".+", re.S)
        self.lengths = [len(p) for p in model.pieces]
        self.plain = [p.replace(SPACE, " ").encode() if k == NORMAL else None for p, k in zip(model.pieces, model.kinds)]
        self.listed = [b"%d," % i for i in range(self.size)]
        self.fits: dict[int, bool] = {}
        self.known, self.known_words = _Known(self, ""), _Known(self, SPACE)

    def number(self, symbol: str) -> int:
        return self.ids[symbol] if symbol in self.ids else self.size + ord(symbol)

    def _edge(self, piece: str, side: int) -> list[tuple[int, float]]:
        """Symbols at one side from the character to the whole piece, each with the rank that ends it."""
        climb = [piece]
        while self.parts.get(climb[-1]):
            climb.append(self.parts[climb[-1]][side])
        climb.reverse()
        return [(self.number(s), self.rank[nxt] if nxt else _NEVER) for s, nxt in zip(climb, [*climb[1:], None])]

    def text(self, token: int) -> str:
        return chr(token - self.size) if token >= self.size else self.model.pieces[token]

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether encoding the joined text of two tokens gives the two tokens."""
        if a in self.odd or b in self.odd:
            return merge(list(self.text(a) + self.text(b)), self.rank)[0] == [self.text(a), self.text(b)]
        right = self.edges[a][0] if a in self.edges else [(a, _NEVER)]
        left = self.edges[b][1] if b in self.edges else [(b, _NEVER)]
        i = j = 0
        while True:
            (u, u_ends), (v, v_ends) = right[i], left[j]
            joined = self.joins.get(u * self.wide + v)
            if joined is not None and joined < u_ends and joined <= v_ends:
                return False
            if u_ends == v_ends == _NEVER:
                return True
            if u_ends <= v_ends:
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[int]:
        """The encoding of a stretch; characters that are no piece have numbers from ``size`` on."""
        last = [-1] * len(text)  # by the place of a prefix's last character
        fits, wide, size, known = self.fits, self.wide, self.size, self.fits.get
        for end, (token, length) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                previous = last[before]
                if previous < 0:  # no piece fits there: the character itself is the token
                    previous = last[before] = size + ord(text[before])
                key = previous * wide + token
                fit = known(key)
                if fit is None:
                    if len(fits) > 1 << 20:
                        fits.clear()
                    fit = fits[key] = self.pair_fits(previous, token)
                if not fit:
                    continue
            last[end] = token
        out, at, lengths = [], len(text) - 1, self.lengths
        while at >= 0:
            token = last[at]
            if 0 <= token < size:
                out.append(token)
                at -= lengths[token]
            else:
                out.append(size + ord(text[at]))
                at -= 1
        out.reverse()
        return out

    def stretch_ids(self, text: str) -> list[int]:
        tokens, out = self.tokens(text), []
        if max(tokens, default=0) < self.size:
            return tokens
        for token in tokens:
            if token < self.size:
                out.append(token)
            elif self.model.byte_fallback:
                out.extend(self.byte_ids[b] for b in chr(token - self.size).encode())
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
        return out

    def stretches(self, text: str) -> list[str]:
        """The prepared text in parts that are encoded alone; without byte fallback in one, as unknowns join."""
        if not text:
            return []
        text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        return self.stretch.findall(text) if self.model.byte_fallback else [text]

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches(text) for i in self.stretch_ids(s)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of the ids; a space mark that begins the text was put there by encoding and goes."""
        out, pending = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.model.kinds[i] == BYTE:
                pending.append(int(self.model.pieces[i][3:5], 16))
                first = False
                continue
            if pending:
                out.append(decode_bytes(bytes(pending)))
                pending.clear()
            if i is None or self.model.kinds[i] == CONTROL:
                continue
            piece = self.model.unknown_text if self.model.kinds[i] == UNKNOWN else self.model.pieces[i]
            if first and self.model.prefix and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids joined by commas, digest of the decoded text."""
        if self.alone and self.model.prefix and self.model.byte_fallback and SPACE not in text and "" not in (words := text.split(" ")):
            found = self.known_words.all(words)  # a space, or the one put before the text, and a word
        else:
            found = self.known.all(self.stretches(text))
        ids = b"".join([f[0] for f in found])[:-1]
        decoded = b"".join([f[1] for f in found])
        if self.model.prefix and decoded.startswith(b" "):
            decoded = decoded[1:]
        return ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


class _Known(dict):
    """For each stretch, found once: its ids with a comma after each, and what they decode to inside a text."""

    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before, self.size = encoder, before, 0

    def __missing__(self, stretch: str) -> tuple[bytes, bytes]:
        encoder = self.encoder
        ids = encoder.stretch_ids(self.before + stretch)
        parts = [encoder.plain[i] for i in ids]
        decoded = encoder.decode(ids, first=False).encode() if None in parts else b"".join(parts)
        found = self[stretch] = b"".join([encoder.listed[i] for i in ids]), decoded
        self.size += len(stretch) + 8
        return found

    def all(self, stretches: list[str]) -> list[tuple[bytes, bytes]]:
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        return list(map(self.__getitem__, stretches))


def decode_bytes(data: bytes) -> str:
    """Bytes as UTF-8; each byte that is no part of a character becomes a replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + decode_bytes(data[e.start + 1 :])


def encode(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), *,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text, and the text they decode to, as the sentencepiece library gives them without begin and end.

    ``columns`` chooses from n_tokens, ids, decoded, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256. Rows stay where they are; nothing is shuffled. A null text counts as empty and has no ids. The key
    may be null or repeat, each row is encoded by itself; other columns are not looked at. The model is read on the driver and sent
    to the tasks; its size is that of the vocabulary.
    """
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.large_string(), "ids_sha256": pa.string(),
             "decoded_sha256": pa.string()}
    sql = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(model_path))
    rows = docs.select(F.col(f"`{key}`"), common.whole_text(f"`{text}`").alias("__text"))
    whole = {"ids", "decoded"} & set(columns)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(shared.value)
            texts = batch.column(1)
            sizes = [len(x) for x in common.text_bytes(texts)]
            for few in _slices(sizes):
                out = {c: [] for c in columns}
                for value in texts.slice(few.start, few.stop - few.start).to_pylist():
                    row = dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), encoder.digests(value)))
                    if whole:
                        row["ids"] = encoder.encode(value)
                        row["decoded"] = encoder.decode(row["ids"])
                    for c in columns:
                        out[c].append(row[c])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(few.start, few.stop - few.start), *[pa.array(out[c], kinds[c]) for c in columns]],
                    names=[key, *columns])

    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} {sql[c]}" for c in columns)
    return rows.mapInArrow(encoded, schema)


def _slices(sizes: list[int], limit: int = common.BATCH_BYTES) -> Iterator[slice]:
    """Rows whose texts hold about ``limit`` bytes together."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield slice(start, len(sizes))
