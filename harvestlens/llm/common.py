"""What the operators share: inputs, words, vectorised hashing, chunks of documents.

A word is a run of bytes other than the six ASCII white-space characters; ``bytes.split()`` and
``WORD`` mean the same. Hashes are polynomials over the bytes of a word modulo 2**64 followed by a
mixing step, so that whole batches of texts are hashed by a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
# Fixed odd multipliers of the word and sequence hashes, one pair for each of two independent hashes.
WORD_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
STEP_BASE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BATCH_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns may have any name."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def all_columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batches(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of about ``limit`` bytes; a longer text is a batch of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BATCH_BYTES + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        if size > 4 * BATCH_BYTES:  # not worth keeping for one very long text
            return out[0], out[1]
        _POWERS[base] = have = (out[0], out[1])
    return have


class Words:
    """The words of a batch of texts: number of the text, place in the batch, hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.joined = joined.lower() if lower else joined
        self.data = np.frombuffer(self.joined, np.uint8)
        self.text_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        edge = np.diff(np.concatenate([[False], ~_SPACE[self.data]]).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # words first[i]:first[i+1] are text i's

    def hashes(self, which: int = 0) -> np.ndarray:
        return self.prefix_hashes([None], which)[0][0]

    def prefix_hashes(self, lengths: list[int | None], which: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: hashes of the first bytes of all longer words, and their places (None: whole words)."""
        every = np.arange(len(self.start))
        if not len(every):
            return [(np.zeros(0, np.uint64), every) for _ in lengths]
        power, inverse = _powers(WORD_BASE[which], len(self.data))
        sums = np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)])
        before = np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
        out = []
        for n in lengths:
            at = every if n is None else np.flatnonzero(self.end - self.start > n)
            end = self.end if n is None else self.start[at] + n
            found = mix((sums[end - 1] - before[at]) * inverse[self.start[at]])
            out.append((found if n is None else mix(found + np.uint64(n)), at))
        return out

    def runs(self, hashes: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of n words inside one text, and the index of its first word."""
        m = len(hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        total = np.zeros(m, np.uint64)
        for k in range(n):
            total = total * np.uint64(STEP_BASE[which]) + hashes[k : k + m]
        return mix(total[at]), at


def chunk_count(docs: DataFrame, column: str, chunk_bytes: int) -> int:
    """Into how many chunks of at most about ``chunk_bytes`` the texts are dealt; grows with the data.

    Small inputs are cut finer, down to a megabyte, so that every partition of a shuffle has some.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    partitions = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // chunk_bytes), min(partitions, total >> 20))


def deltas(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as a compressed block of differences, byte plane by byte plane."""
    import zstandard

    if not len(values):
        return b""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def undeltas(block: bytes) -> np.ndarray:
    import zstandard

    if not block:
        return np.zeros(0, np.uint64)
    width = block[0]
    planes = np.frombuffer(zstandard.decompress(block[1:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view(np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in any order as a compressed block, byte plane by byte plane."""
    import zstandard

    if not len(values):
        return b""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(block: bytes) -> np.ndarray:
    import zstandard

    if not block:
        return np.zeros(0, np.uint64)
    width = block[0]
    planes = np.frombuffer(zstandard.decompress(block[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)
