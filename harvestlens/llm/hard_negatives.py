"""Hard negatives by packed products: one multiplication scores several candidates.

Components are whole numbers. Those of an anchor and of the candidates are raised by their least value, so that none is below
zero, and the same component of several candidates goes into separate fields of one wide number. Multiplying by the
anchor's component and adding up over all components then gives every candidate's product in its own field; fields are
wide enough that none reaches into the next. What the raising added is taken off again. Words of 53 bits
are exact in floating-point numbers; products that need more take Python's integers, which have no end.

Anchors are a stated query set and meet all rows in blocks:

1. rows are packed into chunks of some thousand vectors, anchors into blocks of a few megabytes;
2. chunks meet the anchor blocks of vectors of their length in an equi-join. Blocks are broadcast, as many at a
   time as fit ``BROADCAST_BYTES``. A task keeps the best few of each anchor over all its chunks and passes them on
   packed, 256 anchors at a time; they are merged by such parts: the positives;
3. with the positives' scores as bounds the chunks are gone through again for the negatives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.session import cut

CHUNK_ROWS = 8_192
PACKED_BYTES = 4 << 20  # a chunk has fewer rows where vectors are long; a block about so many bytes
PART = 256  # anchors scored, and their best rows merged, together
BROADCAST_BYTES = 32 << 20
KEPT_BYTES = 64 << 20  # what a task keeps of the best so far
WORD_BITS = 53  # whole numbers below 2**53 are exact in doubles
PYTHON_FIELDS = 16  # candidates in one wide Python integer
_LAST = np.iinfo(np.int64).max
_NONE = np.zeros((0, 4), np.int64)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of 64-bit integers, [anchor, candidate].

    Exact; a result that 64 bits cannot hold raises OverflowError.
    """
    n, m = len(anchors), len(candidates)
    dim = anchors.shape[1]
    if not n or not m or not dim:
        return np.zeros((n, m), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    high_a, high_c = ([int(x) for x in side.max(axis=0)] for side in (anchors, candidates))
    width = max(1, sum((a - low_a) * (c - low_c) for a, c in zip(high_a, high_c)).bit_length())
    if width <= WORD_BITS and dim * max(map(abs, (low_a, low_c, *high_a, *high_c))) ** 2 < 1 << 62:
        fields = WORD_BITS // width
        raised = np.zeros((-(-m // fields) * fields, dim), np.int64)
        raised[:m] = candidates - low_c
        packed = sum(raised[k::fields] << (width * k) for k in range(fields))
        wide = ((anchors - low_a).astype(float) @ packed.T.astype(float)).astype(np.int64)
        out = np.empty((n, len(raised)), np.int64)
        for k in range(fields):
            out[:, k::fields] = (wide >> (width * k)) & ((1 << width) - 1)
        taken_off = low_c * anchors.sum(axis=1)[:, None] + low_a * candidates.sum(axis=1)[None, :] - dim * low_a * low_c
        return out[:, :m] + taken_off
    # The same with integers of any width.
    plain_a = [[int(x) - low_a for x in row] for row in anchors]
    plain_c = [[int(x) - low_c for x in row] for row in candidates]
    sum_a, sum_c = ([sum(map(int, row)) for row in side] for side in (anchors, candidates))
    out = np.empty((n, m), np.int64)
    mask = (1 << width) - 1
    for start in range(0, m, PYTHON_FIELDS):
        few = plain_c[start : start + PYTHON_FIELDS]
        packed = [sum(row[d] << (width * k) for k, row in enumerate(few)) for d in range(dim)]
        for i, row in enumerate(plain_a):
            wide = sum(a * p for a, p in zip(row, packed))
            for k in range(len(few)):
                out[i, start + k] = (((wide >> (width * k)) & mask) + low_c * sum_a[i] + low_a * sum_c[start + k]
                                     - dim * low_a * low_c)
    return out


def first_places(scores: np.ndarray, allowed: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the places of the n greatest allowed scores, greatest first, of equals the first place."""
    out = []
    for row, ok in zip(scores, allowed):
        at = np.flatnonzero(ok)
        if len(at) > n:
            least = np.partition(row[at], len(at) - n)[len(at) - n]
            at = at[row[at] >= least]
        out.append(at[np.argsort(-row[at], kind="stable")][:n])
    return out


class Best:
    """The best rows so far by key (block, anchor, ...): columns score, id, whether the id is null, place."""

    def __init__(self):
        self.kept: dict[tuple, np.ndarray] = {}

    def add(self, key: tuple, found: np.ndarray, n: int) -> None:
        if key in self.kept:
            found = np.concatenate([self.kept[key], found])
        if len(found):
            self.kept[key] = found[np.lexsort((found[:, 3], found[:, 1], found[:, 2], -found[:, 0]))[:n]]

    def size(self) -> int:
        return 400 * len(self.kept)

    def parts(self) -> Iterator[pa.RecordBatch]:
        """Everything kept, packed by block and part; nothing is kept any longer."""
        packed: dict[tuple[int, int], dict] = {}
        for key, found in self.kept.items():
            packed.setdefault((key[0], key[1] // PART), {})[key] = found
        self.kept = {}
        if packed:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in packed], pa.int64()), pa.array([k[1] for k in packed], pa.int64()),
                pa.array([pickle.dumps(x) for x in packed.values()], pa.binary())], names=["block", "part", "kept"])


def _merged(kept: list[bytes], n: int) -> dict[tuple, np.ndarray]:
    best = Best()
    for part in kept:
        for key, found in pickle.loads(part).items():
            best.add(key, found, n)
    return best.kept


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them."""
    for kind in (np.int16, np.int32):
        if not matrix.size or (matrix.min() >= np.iinfo(kind).min and matrix.max() <= np.iinfo(kind).max):
            return matrix.astype(kind)
    return matrix


def _pack_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of vectors of one length out of each partition, rows by id, nulls last."""
    def chunk(table: pa.Table, dim: int) -> bytes:
        null = np.asarray(table["id"].is_null())
        number = np.where(null, _LAST, np.asarray(table["id"].fill_null(0)))
        order = np.lexsort((number, null))
        vectors = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), dim)
        return pickle.dumps({
            "id": number[order], "null": null[order], "label": np.asarray(table["label"])[order],
            "anchor": np.asarray(table["anchor"])[order], "vector": _narrow(vectors[order].astype(np.int64))})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: dict[int, list[pa.RecordBatch]] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            table = pa.Table.from_batches(open_.pop(dim))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([sum(table["anchor"].to_pylist())], pa.int64()),
                 pa.array([chunk(table, dim)], pa.binary())], names=["chunk", "dim", "anchors", "payload"])

        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column("vector")))
            for dim in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                limit = max(1, min(CHUNK_ROWS, PACKED_BYTES // (8 * max(1, dim))))
                while part.num_rows:
                    room = limit - sum(b.num_rows for b in open_.get(dim, []))
                    open_.setdefault(dim, []).append(part.slice(0, room))
                    if part.num_rows >= room:
                        yield close(dim)
                    part = part.slice(room)
        for dim in list(open_):
            yield close(dim)

    return rows.mapInArrow(packed, "chunk long, dim int, anchors long, payload binary")


def _pack_blocks(chunks: DataFrame) -> DataFrame:
    """The anchors of all chunks, dealt by hash into blocks of about ``PACKED_BYTES``."""
    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, dim, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = pickle.loads(payload)
                at = np.flatnonzero(rows["anchor"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), number)), pa.array(np.full(len(at), dim, np.int32)), pa.array(at),
                    pa.array([pickle.dumps({k: rows[k][i] for k in ("id", "null", "label", "vector")}) for i in at.tolist()], pa.binary())],
                    names=["chunk", "dim", "place", "row"])

    def block(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["chunk", "place"])
        rows = [pickle.loads(r) for r in pdf["row"]]
        whole = {k: np.array([r[k] for r in rows]) for k in ("id", "null", "label")}
        whole |= {"vector": np.stack([r["vector"] for r in rows]), "chunk": pdf["chunk"].to_numpy(), "place": pdf["place"].to_numpy()}
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "dim": pdf["dim"].iloc[:1], "payload": [pickle.dumps(whole)]})

    has = chunks.where("anchors > 0")
    total = has.agg(F.sum(F.col("anchors") * (8 * F.col("dim") + 64))).first()[0] or 0
    blocks = -(-total // PACKED_BYTES)
    if not blocks:
        return chunks.select(F.lit(0).cast("long").alias("block"), "dim", "payload").limit(0)
    rows = has.select("chunk", "dim", "payload").mapInArrow(picked, "chunk long, dim int, place long, row binary")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("chunk", "place"), F.lit(blocks)) * (1 << 20) + F.col("dim") % (1 << 20))
    return dealt.groupBy("block", "dim").applyInPandas(block, "block long, dim int, payload binary")


def _meet(chunks: DataFrame, blocks: DataFrame, search: Callable[[Best, int, dict, dict, dict], None]) -> DataFrame:
    """Every chunk with every block of vectors of its length; what ``search`` kept of them, by block and part.

    ``blocks`` has the goals of each anchor packed beside the anchors, or none.
    """
    groups, room = [], 0
    sizes = blocks.groupBy("block").agg(F.sum(F.octet_length("payload") + F.aggregate(
        "goals", F.lit(0), lambda t, g: t + F.octet_length(g))).alias("bytes"))
    for r in sizes.orderBy("block").collect():  # one row for some megabytes of anchors
        if not groups or r.bytes > room:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(r.block)
        room -= r.bytes

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best()
        for batch in batches:
            for number, of_chunk, anchors, goals, rows in zip(*(c.to_pylist() for c in batch.columns)):
                block, chunk, wanted = pickle.loads(anchors), pickle.loads(rows), {}
                for g in goals:
                    wanted |= pickle.loads(g)
                search(best, number, block | {"goals": wanted}, chunk | {"chunk": of_chunk})
                if best.size() > KEPT_BYTES:
                    yield from best.parts()
        yield from best.parts()

    parts = []
    for group in groups:
        some = F.broadcast(blocks.where(F.col("block").between(group[0], group[-1])).select(
            "block", "dim", F.col("payload").alias("of_block"), "goals"))
        met = chunks.join(some, "dim").select("block", "chunk", "of_block", "goals", "payload")
        parts.append(met.mapInArrow(searched, "block long, part long, kept binary"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _scores(block: dict, chunk: dict) -> Iterator[tuple[slice, np.ndarray]]:
    """Anchors and scores of each part of a block."""
    candidates = chunk["vector"].astype(np.int64)
    for start in range(0, len(block["id"]), PART):
        some = slice(start, min(start + PART, len(block["id"])))
        yield some, products(block["vector"][some].astype(np.int64), candidates)


def mine(rows: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         scale: int = 256, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """For each anchor and each of its best positives, the best rows of another label that come close to the positive.

    A component x becomes floor(scale * x); a score is the inner product of such vectors, exact. Greater scores come first, of equals the
    smaller key, null last. The positives of an anchor are its first ``positives`` other rows of its label; the negatives of a
    positive of score p are the first ``negatives`` rows of another label with share * p <= 100 * score <= 100 * p.

    Rows with a null label or vector, or a null or non-finite component, take no part. Vectors of different lengths have
    no score with each other. A row is an anchor by ``anchor``, a condition on the columns of ``rows`` (null: it is none). Rows that
    repeat a key are rows of their own. Components are cut to 64 bits; a score beyond 64 bits is an error. Returns
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; nothing for no anchors.
    """
    spark = rows.sparkSession
    mark = F.col(f"`{label}`") if isinstance(label, str) else label
    usable = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"), mark.cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    usable = usable.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = usable.select("id", "label", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"), "anchor")
    n = rows.count()  # every task gets rows, and some full chunks of many rows
    tasks = max(1, min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 256), n // (8 * CHUNK_ROWS))
    chunks = cut(_pack_chunks(whole.repartition(tasks)))
    blocks = cut(_pack_blocks(chunks))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if blocks.isEmpty():
        return spark.createDataFrame([], result)

    def same_label(best: Best, number: int, block: dict, chunk: dict) -> None:
        places = np.arange(len(chunk["id"]))
        for some, scores in _scores(block, chunk):
            itself = (block["chunk"][some] == chunk["chunk"])[:, None] & (block["place"][some][:, None] == places)
            same = (block["label"][some][:, None] == chunk["label"]) & ~itself
            for i, row, at in zip(range(some.start, some.stop), scores, first_places(scores, same, positives), strict=True):
                best.add((number, i, block["id"][i].item(), block["null"][i].item()), _columns(row, at, chunk), positives)

    def merged(pdf):
        import pandas as pd

        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1],
                             "goals": [pickle.dumps(_merged(list(pdf["kept"]), positives))]})

    kept = _meet(chunks, blocks.withColumn("goals", F.array().cast("array<binary>")), same_label)
    goals = cut(kept.groupBy("block", "part").applyInPandas(merged, "block long, part long, goals binary"))
    if goals.isEmpty():
        return spark.createDataFrame([], result)

    def other_label(best: Best, number: int, block: dict, chunk: dict) -> None:
        wanted = {key[1]: found for key, found in block["goals"].items()}
        for some, scores in _scores(block, chunk):
            for i, row in zip(range(some.start, some.stop), scores, strict=True):
                if i not in wanted:
                    continue
                p = np.unique(wanted[i][:, 0])
                least = -(-share * p // 100)
                at = np.flatnonzero((row >= least.min()) & (row <= p.max()) & (chunk["label"] != block["label"][i]))
                at = at[np.argsort(-row[at], kind="stable")]  # by score, then id
                first, last = np.searchsorted(-row[at], -p, "left"), np.searchsorted(-row[at], -least, "right")
                for k in np.flatnonzero(first < last).tolist():
                    few = at[first[k] : min(last[k], first[k] + negatives)]
                    best.add((number, i, p[k].item()), _columns(row, few, chunk), negatives)

    found = _meet(chunks, blocks.join(goals.groupBy("block").agg(F.collect_list("goals").alias("goals")), "block"), other_label)

    def listed(ours, theirs):
        import pandas as pd

        out, best = [], _merged(list(theirs["kept"]), negatives)
        for part in ours["goals"]:
            for (number, i, anchor_id, no_id), best_of_label in pickle.loads(part).items():
                for p, p_id, p_null, _ in best_of_label.tolist():
                    for rank, (score, other, null, _) in enumerate(best.get((number, i, p), _NONE).tolist(), 1):
                        out.append((None if no_id else anchor_id, None if p_null else p_id, rank, None if null else other, p, score))
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        return pd.DataFrame({c: pd.array([r[k] for r in out], "Int32" if c == "rank" else "Int64") for k, c in enumerate(names)})

    by = ("block", "part")
    return goals.groupBy(*by).cogroup(found.groupBy(*by)).applyInPandas(listed, result)


def _columns(scores: np.ndarray, at: np.ndarray, chunk: dict) -> np.ndarray:
    return np.stack([scores[at], chunk["id"][at], chunk["null"][at].astype(np.int64), at], axis=1)
