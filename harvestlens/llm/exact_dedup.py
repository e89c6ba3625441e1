"""Exact deduplication routed by counting quotient filters.

Every partition builds counting quotient filters of the fingerprints of its texts, one for each
range of fingerprints. Filters of a range hold sorted remainders, so they merge without loss by
merging sorted runs, and counters add up. A fingerprint whose merged counter is one belongs to a
text that exists once. Texts whose fingerprint is counted more often are compared byte by byte.

Only the texts whose fingerprint may repeat are shuffled: the quotients of the repeated fingerprints
form a bitmap of at most ``BITMAP_WORDS`` words, which every row is held against first. A row that
passes by chance is settled by the comparison of bytes like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm import common
from harvestlens.session import cut

FINGERPRINT_BITS = 56
REMAINDER_BITS = 32
BITMAP_WORDS = 1 << 16  # 64 quotients each; 512 KB, whatever the data


class QuotientFilter:
    """A counting quotient filter over a sorted multiset of fingerprints of one range.

    The upper bits (quotient) choose a run, the lower bits (remainder) are stored in the run in
    ascending order. ``occupied`` marks quotients that have a run, ``run_end`` the last slot of each
    run, ``repeated`` the slots whose counter exceeds one; ``extra`` holds those counters, less one.
    """

    def __init__(self, quotients: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, repeated: np.ndarray,
                 extra: np.ndarray):
        self.occupied, self.run_end, self.remainders = quotients, run_end, remainders
        self.repeated, self.extra = repeated, extra

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From distinct sorted fingerprints and their counts."""
        quotients = keys >> np.uint64(REMAINDER_BITS)
        run_end = np.concatenate([quotients[1:] != quotients[:-1], np.ones(min(1, len(keys)), bool)])
        repeated = counts > 1
        return cls(quotients[run_end], run_end, (keys & np.uint64((1 << REMAINDER_BITS) - 1)).astype(np.uint32),
                   repeated, counts[repeated] - 1)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints in ascending order, and their counts."""
        run = np.cumsum(self.run_end) - self.run_end
        keys = (self.occupied[run] << np.uint64(REMAINDER_BITS)) | self.remainders.astype(np.uint64)
        counts = np.ones(len(keys), np.int64)
        counts[self.repeated] += self.extra.astype(np.int64)
        return keys, counts

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        parts = [f.items() for f in filters]
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")  # runs that are sorted already
        keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return cls.of(keys[first], np.add.reduceat(counts, first) if len(first) else counts)

    def to_row(self) -> tuple[bytes, ...]:
        bits = lambda x: len(x).to_bytes(8, "little") + np.packbits(x).tobytes()
        return (common.deltas(self.occupied), bits(self.run_end), self.remainders.tobytes(), bits(self.repeated),
                common.pack(self.extra))

    @classmethod
    def from_row(cls, occupied: bytes, run_end: bytes, remainders: bytes, repeated: bytes, extra: bytes):
        bits = lambda x: np.unpackbits(np.frombuffer(x[8:], np.uint8),
                                       count=int.from_bytes(x[:8], "little")).astype(bool)
        return cls(common.undeltas(occupied), bits(run_end), np.frombuffer(remainders, np.uint32), bits(repeated),
                   common.unpack(extra))


FILTER_SCHEMA = "range int, occupied binary, run_end binary, remainders binary, repeated binary, extra binary"
_FIELDS = ["occupied", "run_end", "remainders", "repeated", "extra"]


def partition_filters(ranges: int, flush: int = 1 << 20):
    """A filter for each range of fingerprints and each ``flush`` rows of a partition."""

    def rows(keys: np.ndarray) -> pa.RecordBatch:
        keys, counts = np.unique(keys, return_counts=True)
        span = (1 << FINGERPRINT_BITS) // ranges + 1
        place = (keys // np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        found = [(int(place[a]), *QuotientFilter.of(keys[a:b], counts[a:b]).to_row())
                 for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
        return pa.RecordBatch.from_pylist([dict(zip(["range", *_FIELDS], r, strict=True)) for r in found], SCHEMA_ARROW)

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            held.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            size += part.num_rows
            if size >= flush:
                yield rows(np.concatenate(held))
                held, size = [], 0
        if size:
            yield rows(np.concatenate(held))

    return build


SCHEMA_ARROW = pa.schema([("range", pa.int32()), *[(f, pa.binary()) for f in _FIELDS]])


def merge_range(blocks: pa.Table) -> pa.Table:
    """Merge the filters of one range; return its repeated fingerprints."""
    filters = [QuotientFilter.from_row(*[row[f] for f in _FIELDS]) for row in blocks.to_pylist()]
    keys, counts = QuotientFilter.merge(filters).items()
    again = counts > 1
    return pa.table({"fingerprint": keys[again].astype(np.int64), "copies": counts[again].astype(np.int64)})


def repeated_fingerprints(fingerprints: DataFrame, ranges: int) -> DataFrame:
    """Fingerprints counted more than once, with their counts, by merged quotient filters."""
    filters = fingerprints.mapInArrow(partition_filters(ranges), FILTER_SCHEMA)
    return filters.groupBy("range").applyInArrow(merge_range, "fingerprint long, copies long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal
    when their bytes are; null counts as empty. The row with the largest doc_id stays; a null doc_id
    is smaller than any other, and of repeated rows with one doc_id exactly one stays. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    texts = common.own_columns(docs, "doc_id", "text").withColumn("text", common.whole_text())
    mask = (1 << FINGERPRINT_BITS) - 1
    fingerprint = F.xxhash64("text").bitwiseAND(F.lit(mask))
    keys = cut(texts.select("doc_id", fingerprint.alias("fingerprint"), F.sha2("text", 256).alias("text_sha256"))
               .withColumn("row", F.monotonically_increasing_id()))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = cut(repeated_fingerprints(keys.select("fingerprint"), ranges))

    low = FINGERPRINT_BITS - (64 * BITMAP_WORDS).bit_length() + 1  # the bitmap has a bit for each leading quotient
    quotient = F.shiftright("fingerprint", low)
    one = F.expr("shiftleft(1L, cast(quotient % 64 as int))")
    bitmap = (again.select(quotient.alias("quotient"))
              .groupBy(F.shiftright("quotient", 6).alias("word")).agg(F.bit_or(one).alias("bits")))
    routed = (texts.select("text", fingerprint.alias("fingerprint"))
              .withColumn("quotient", quotient).withColumn("word", F.shiftright("quotient", 6))
              .join(F.broadcast(bitmap), "word")
              .filter(F.col("bits").bitwiseAND(one) != 0))
    equal = (routed.groupBy("fingerprint", "text").agg(F.count(F.lit(1)).alias("group_size"))
             .filter("group_size > 1")
             .select("fingerprint", F.sha2("text", 256).alias("text_sha256"), "group_size"))
    names = ["fingerprint", "text_sha256"]
    best = keys.groupBy(*names).agg(F.max(F.struct("doc_id", "row")).alias("best"))  # before the join: copies collapse
    winner = best.join(equal, names)
    return (keys.join(winner, names, "left")
            .select("doc_id",
                    F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
                    "text_sha256", "row"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``. Of repeated rows with one doc_id one stays."""
    i, none, sha, n = names = common.fresh(docs, "id", "none", "sha", "n")
    key = [F.coalesce("doc_id", F.lit(0)).alias(i), F.col("doc_id").isNull().alias(none)]
    stay = exact_groups(docs).filter("kept").select(*key, F.col("text_sha256").alias(sha))
    marked = docs.select(*common.all_columns(docs), *key, F.sha2(common.whole_text(), 256).alias(sha))
    number = F.row_number().over(Window.partitionBy(*names[:3]).orderBy(i))
    return (marked.join(stay, names[:3], "left_semi").withColumn(n, number).filter(F.col(n) == 1)
            .select(*common.all_columns(docs)))
