"""Near-duplicate groups: MinHash samples, odd sketches, banded candidates, exact confirmation.

A text is the set of its 5-word shingles. MinHash samples of the set are cut into ``BANDS`` bands of ``ROWS``; sets that agree in a band are candidates. All ``SAMPLES`` samples are folded into an odd sketch, a
bitmap in which every sample flips one bit: the number of ones in the XOR of two sketches estimates
how many samples differ, and rejects most false candidates without touching their texts. What is
left is confirmed on full shingle sets.

Two sets with similarity 0.75 share a band with probability 1 - (1 - 0.75**4)**32 > 0.99999, and the
sketch limit lies more than four standard deviations below 0.75 (with 1,024 samples and 4,096 bits a similarity of 0.75
is estimated within 0.0145). Sets whose sizes differ by more than a quarter cannot be as similar, and are passed over.

Groups are kept small without dropping anything. Equal sets become one class before anything is
joined. In the first round every class is compared to the smallest of each of its buckets only.
Then classes that are linked already need no comparison among themselves; buckets that still hold
several components are compared across components, in blocks of bounded size. Every round offers the
candidates of the next ranks; each pair is offered once, unless it has been linked through others
before, and rounds go on until no candidate is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common
from harvestlens.llm.components import components
from harvestlens.session import cut

SHINGLE = 5
PERCENT = 75
SAMPLES, ROWS, BANDS = 1024, 4, 32  # the bands use the first samples, the sketch all
SKETCH_BITS = 4096
ESTIMATE = 0.685  # candidates whose estimated similarity is below are not confirmed
BLOCK = 2048  # members of a bucket compared in one task
WIDER = 8  # every round offers the candidates of the next ranks, so many times as far

_INDEX = np.arange(1, SAMPLES + 1, dtype=np.uint64)
_FACTOR = (common.mix(_INDEX) | np.uint64(1)).astype(np.uint32)
_SHIFT = common.mix(_INDEX + np.uint64(1 << 20)).astype(np.uint32)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a shorter text its whole word sequence."""
    for part in common.batches(texts):
        words = common.Words(texts[part], lower=True)
        hashes = words.hashes()
        runs, at = words.runs(hashes, n)
        cuts = np.searchsorted(at, words.first)
        for i, count in enumerate(words.count):
            if count >= n:
                yield np.unique(runs[cuts[i]:cuts[i + 1]])
            elif count:
                whole = np.uint64(count)
                for h in hashes[words.first[i]:words.first[i + 1]]:
                    whole = np.uint64((int(whole) * common.STEP_BASE[0] + int(h)) & (2**64 - 1))
                yield common.mix(np.array([whole]))
            else:
                yield np.zeros(0, np.uint64)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes."""
    least = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 512):
        x = (shingles[i:i + 512] >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (_FACTOR[:, None] * x + _SHIFT[:, None]).min(axis=1), out=least)
    return least


def bands(sample: np.ndarray) -> np.ndarray:
    """A hash for each band of samples; its number is part of the hash."""
    rows = sample[:BANDS * ROWS].reshape(-1, ROWS).astype(np.uint64)
    total = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = common.mix(total * np.uint64(common.STEP_BASE[1]) + rows[:, k])
    return total.view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples, as 64-bit words."""
    bit = common.mix((_INDEX << np.uint64(32)) | sample.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def most_ones(similarity: float = ESTIMATE) -> int:
    """Ones in the XOR of two sketches at a similarity: each differing sample counts twice."""
    differing = 2 * SAMPLES * (1 - similarity)
    return int(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


SIGNATURES = "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch array<long>"


def _signatures(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.int64())
    for part in parts:
        count, high, low, band, sketch = [], [], [], [], []
        for shingles in shingle_sets(common.text_bytes(part.column(1))):
            count.append(len(shingles))
            again = common.mix(shingles ^ np.uint64(common.WORD_BASE[1]))
            high.append(np.uint64(shingles.sum(dtype=np.uint64)).view(np.int64))
            low.append(np.uint64(again.sum(dtype=np.uint64)).view(np.int64))
            sample = samples(shingles)
            band.append(bands(sample) if len(shingles) else None)
            sketch.append(odd_sketch(sample) if len(shingles) else None)
        yield pa.record_batch(
            [part.column(0), pa.array(count, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
             pa.array(band, lists), pa.array(sketch, lists)],
            ["doc_id", "n_shingles", "high", "low", "bands", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    texts = common.own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), common.whole_text().alias("text"))
    return texts.mapInArrow(_signatures, SIGNATURES)


def similar_sketches(left: str, right: str, size_left: str, size_right: str):
    """Whether two sketches leave a similarity of ``ESTIMATE`` possible, and two set sizes ``PERCENT``."""
    sizes = 100 * F.least(size_left, size_right) >= PERCENT * F.greatest(size_left, size_right)
    ones = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return sizes & (ones <= most_ones())


def _confirm(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        left = shingle_sets(common.text_bytes(part.column(2)))
        right = shingle_sets(common.text_bytes(part.column(3)))
        keep = []
        for x, y in zip(left, right, strict=True):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar; ``texts`` has doc_id and text."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm, "a long, b long").distinct()


def _across(low: int, high: int):
    """Candidate pairs between different components in a block of a bucket (or between two blocks).

    A pair belongs to its larger id and to the first bucket that both share. The candidates of a member are
    ranked by their sketches; those of the ranks from ``low`` to ``high`` are offered.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, comp, size = (table[c].to_numpy() for c in ("member", "component", "n_shingles"))
        side, bucket = table["side"].to_numpy(), table["bucket"][0].as_py()
        sketch = np.stack(table["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        band = np.stack(table["bands"].to_numpy()).astype(np.int64)
        own = np.argmax(band == bucket, axis=1)  # the band that this bucket belongs to
        two_blocks = bool(side.max())
        found_a, found_b, more = [], [], False
        for i in range(len(ids)):
            near = (ids < ids[i]) & (100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i]))
            other = np.flatnonzero(near & (side != side[i]) if two_blocks else near)
            if not (comp[other] != comp[i]).any():
                continue
            ones = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1)
            other, ones = other[ones <= most_ones()], ones[ones <= most_ones()]
            first = np.argmax(band[other] == band[i], axis=1) == own[i]  # the pair meets nowhere before
            other, ones = other[first], ones[first]
            other = other[np.lexsort((ids[other], ones))]
            away = comp[other] != comp[i]
            more |= bool(away[high:].any())
            found_b += ids[other[low:high][away[low:high]]].tolist()
            found_a += [int(ids[i])] * (len(found_b) - len(found_a))
        if more:  # a pair of equal ids says that more candidates wait for a later round
            found_a.append(int(ids[0]))
            found_b.append(int(ids[0]))
        return pa.table({"a": pa.array(found_b, pa.int64()), "b": pa.array(found_a, pa.int64())})

    return run


def _left_over(members: DataFrame, classes: DataFrame, labels: DataFrame, low: int, high: int) -> DataFrame:
    """Candidates of some ranks between components that share a bucket of three or more members."""
    now = (members.join(labels, members["member"] == labels["node"], "left")
           .select("bucket", "member", F.coalesce("component", "member").alias("component")))
    open_ = (now.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"),
                                       F.max("component").alias("hi"))
             .filter("size > 2 and lo <> hi")
             .select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    split = now.join(open_, "bucket").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = split.select("bucket", "member", "component", F.least("own", "other").alias("i"),
                          F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    sketched = placed.join(classes.select(F.col("doc_id").alias("member"), "n_shingles", "bands", "sketch"), "member")
    return sketched.groupBy("bucket", "i", "j").applyInArrow(_across(low, high), "a long, b long").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links: only the components that they touch are worked on."""
    a, b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = cut(components(between)).withColumnsRenamed({"node": "old", "component": "new"})
    kept = labels.join(joined, F.col("component") == F.col("old"), "left").select(
        "node", F.coalesce("new", "component").alias("component"))
    first = joined.join(labels.select("node"), F.col("old") == F.col("node"), "left_anti")  # classes not linked so far
    return kept.union(first.select("old", "new"))


def near_groups(docs: DataFrame) -> DataFrame:
    """Groups of similar texts of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links
    of similarity 0.75 or more), kept (doc_id = component_id). Texts without words (null, empty, only
    white space) are linked with nothing. Rows with a null doc_id take no part: they come back with
    a null component and are kept. A doc_id names one text here: rows that repeat one with the same text share
    its links, with different texts they are linked through either (``drop_similar`` tells them apart). An empty
    table gives no rows.
    """
    signed = cut(signatures(docs))
    digest = ["high", "low", "n_shingles"]
    able = signed.filter("n_shingles > 0 and doc_id is not null")
    named = able.groupBy(*digest).agg(F.min("doc_id").alias("class"))
    classes = cut(able.join(named, digest).filter("doc_id = class").select("doc_id", "n_shingles", "bands", "sketch"))
    members = classes.select(F.col("doc_id").alias("member"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("member").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(members.join(shared, "bucket").select("bucket", "member", "first"))

    pairs = members.filter("member > first").select(F.col("first").alias("a"), F.col("member").alias("b")).distinct()
    left, right = (classes.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n_shingles").alias(f"n_{c}"))
                   for c in "ab")
    tried = cut(pairs.join(left, "a").join(right, "b").filter(similar_sketches("sketch_a", "sketch_b", "n_a", "n_b"))
                .select("a", "b").distinct())
    texts = common.own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), common.whole_text().alias("text"))
    labels = cut(components(confirmed(tried, texts)))
    low, high, waiting = 0, 1, True
    while waiting:
        offered = cut(_left_over(members.select("bucket", "member"), classes, labels, low, high))
        fresh = cut(offered.filter("a <> b").join(tried, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            more = cut(confirmed(fresh, texts))
            if not more.isEmpty():
                labels = cut(_merged(labels, more))
        waiting = not offered.filter("a = b").isEmpty()
        low, high = high, high * WIDER
    return (signed.join(named, digest, "left").join(labels, F.col("class") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(
                F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, with the columns of ``docs``: the one with the smallest doc_id.

    Rows are told apart by a number of their own, so that a doc_id may be null (larger than any other) or repeat: rows of one
    doc_id that differ in text are judged each by its text, and of equal rows one stays. Rows without words all stay.
    """
    i, row = common.fresh(docs, "id", "row")
    numbered = cut(docs.select(*common.all_columns(docs), F.monotonically_increasing_id().alias(row)))
    named = numbered.select(F.col(row).alias("doc_id"), F.col("`text`").alias("text"))
    ids = numbered.select(F.col(row).alias("row"), F.col("`doc_id`").alias("id"))
    groups = near_groups(named).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    stay = groups.join(ids, "row").groupBy("component").agg(F.min(order).alias("first"))
    # Most rows stay: those that go are fewer to join with.
    gone = groups.join(stay, "component").filter("row <> first.row").select(F.col("row").alias(i))
    return numbered.join(gone, F.col(row) == F.col(i), "left_anti").select(*common.all_columns(docs))
