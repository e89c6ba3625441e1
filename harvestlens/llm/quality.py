"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, in 5-grams, so that it covers any word and still sees that a word does not
follow itself; it is counted in Spark from texts of rows that ``labels`` marks as good. A document is kept
when its perplexity stays below a threshold of its language: the observed quantile ``LEVEL`` of trusted documents
that the model has not seen.

Texts meet the model by joins. The distinct n-grams of all texts are joined, order by order, with the counted tables,
which are sharded by n-gram: one that has a probability takes it, the others go on to the weight of their context
and to their end, one character shorter. Texts travel as blocks of about 32 million characters; a block asks for each of
its n-grams once, and the answers come back to the block. How often an n-gram is asked for is bounded by the number
of blocks, however often it occurs.

An n-gram is two numbers, 21 bits for a code point: ``lo`` has the last three, ``hi`` those before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common
from harvestlens.session import cut

ORDER = 5
BROADCAST_IDS = 1_000_000  # ids and languages of training rows that are broadcast, some 30 MB
HELD_OUT = 5  # one in so many trusted rows is kept from the model and sets the threshold
LEVEL = 0.99  # the threshold is this quantile of the held-out rows of a language
ENOUGH = 100  # held-out rows of a language from which its observed quantile lies below its greatest value
UPPER = 2.3263  # normal deviate of ``LEVEL``
SURE = 1.6449  # normal deviate of the confidence, 95 %, of the limit for languages with fewer
LEAST = 3  # held-out rows that a language needs for a spread of its own
PRIOR = 100  # a text counts as if so many characters of median perplexity stood before it
CHUNK_BYTES = 4 << 20  # characters that are counted or scored at a time, about
SLICES = 8  # so many of these are a block
BITS = 21
START, END = 0x110000, 0x110001  # beyond the last code point
_LOW = (1 << BITS) - 1


def _halves(points: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """hi and lo of n-grams given character by character."""
    hi, lo = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for k, own in enumerate(points):
        if k < len(points) - 3:
            hi = hi << BITS | own
        else:
            lo = lo << BITS | own
    return hi, lo


class Grams:
    """The n-grams of some texts, ``order - 1`` START before and one END behind each: the distinct ones, and which stand where."""

    def __init__(self, texts: list[str | None], order: int = ORDER):
        edge = np.full(order - 1, START, np.uint32), np.array([END], np.uint32)
        parts = [p for t in texts for p in (edge[0], np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32), edge[1])]
        lengths = np.array([len(p) for p in parts], np.int64).reshape(-1, 3).sum(axis=1)
        self.count = lengths - (order - 1)
        points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        del parts
        size = max(len(points) - order + 1, 0)
        inside = np.ones(size, bool)
        for end in np.cumsum(lengths)[:-1]:  # none begins in one text and ends in the next
            inside[end - order + 1:end] = False
        there = np.zeros(END + 1, bool)
        there[points] = True
        letters = np.flatnonzero(there)
        bits = max(1, int(len(letters) - 1).bit_length())
        if order * bits <= 63:  # all characters of an n-gram in one number
            code = np.zeros(END + 1, np.uint32)
            code[letters] = np.arange(len(letters), dtype=np.uint32)
            points, key = code[points], np.zeros(size, np.int64)
            for k in range(order):  # in place: a chunk's numbers are the most that a task holds
                key <<= bits
                key |= points[k:k + size]
            del points
            key = key[inside]
            coded = pa.array(key).dictionary_encode()
            del key
            key = coded.dictionary.to_numpy()
            spelt = [letters[key >> bits * (order - 1 - k) & (1 << bits) - 1] for k in range(order)]
            self.at, (self.hi, self.lo) = coded.indices.to_numpy(), _halves(spelt, len(key))
            return
        at, points = np.flatnonzero(inside), points.astype(np.int64)
        hi, lo = _halves([points[at + k] for k in range(order)], len(at))
        left, right = pa.array(hi).dictionary_encode(), pa.array(lo).dictionary_encode()
        pair = pa.array(left.indices.to_numpy().astype(np.int64) << 32 | right.indices.to_numpy()).dictionary_encode()
        self.at, code = pair.indices.to_numpy(), pair.dictionary.to_numpy()
        self.hi = left.dictionary.to_numpy()[code >> 32]
        self.lo = right.dictionary.to_numpy()[code & 0xFFFFFFFF]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over its n-grams for each text."""
        first = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if len(self.count) else np.zeros(0, np.int64)
        return np.add.reduceat(values[self.at], first) if len(first) else np.zeros(0)


def _slices(texts: list[str | None], size: int) -> Iterator[slice]:
    """Texts of about so many characters at a time; a longer text is alone or the last."""
    cuts = np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // size, prepend=-1)).tolist() if texts else []
    yield from (slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True) if b > a)


def _counts(order: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(0).to_pylist()
            for own in _slices(texts, CHUNK_BYTES):
                grams = Grams(texts[own], order)
                n = np.bincount(grams.at, minlength=len(grams.lo))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (grams.hi, grams.lo, n)], ["hi", "lo", "n"])

    return run


def _context() -> tuple:
    """context_hi and context_lo: an n-gram without its last code point."""
    before = F.shiftleft(F.col("hi").bitwiseAND(F.lit(_LOW)), 2 * BITS).bitwiseOR(F.shiftright("lo", BITS))
    return F.shiftright("hi", BITS).alias("context_hi"), before.alias("context_lo")


def _discounted(grams: DataFrame) -> DataFrame:
    """Discounts D1, D2, D3+ of modified Kneser-Ney on every row (hi, lo, n), its context and the totals of that."""
    few = grams.groupBy(F.least(F.col("n"), F.lit(5)).alias("k")).count()
    c = {r.k: r["count"] for r in few.collect()}  # at most five rows
    t = [0, *[c.get(k, 0) for k in (1, 2, 3, 4)]]
    y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
    d = [min(max(k - (k + 1) * y * t[k + 1] / t[k], 0.05), k - 0.05) if t[k] else 0.5 * k for k in (1, 2, 3)]
    discount = F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
    rows = grams.select("*", *_context(), discount.alias("discount"))
    totals = rows.groupBy("context_hi", "context_lo").agg(F.sum("n").alias("total"), F.sum("discount").alias("mass"))
    return rows.join(totals, ["context_hi", "context_lo"])


def _ends(order: int) -> tuple:
    """hi and lo of an n-gram of that order without its first code point."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * max(order - 4, 0)) - 1))
    return hi, F.col("lo").bitwiseAND(F.lit((1 << BITS * min(order - 1, 3)) - 1))


def train(trusted: DataFrame, order: int = 3) -> DataFrame:
    """The model of the texts of ``trusted`` (text), of order 3 to 5: order, hi, lo, p, backoff.

    A row of the highest order holds its probability; a row of a lower order n the probability of its last
    character after the others, and the weight that n-grams of the next order with it as context leave
    to that order; order 0 the probability of a character never seen. An empty table gives the row of order 0 only.
    """
    spark = trusted.sparkSession
    counts = {order: cut(trusted.select(common.whole_text().alias("text")).mapInArrow(_counts(order), "hi long, lo long, n long")
                         .groupBy("hi", "lo").agg(F.sum("n").alias("n")))}
    for k in range(order, 1, -1):
        hi, lo = _ends(k)
        counts[k - 1] = cut(counts[k].groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count(F.lit(1)).alias("n")))
    size = counts[1].count()
    none = F.lit(None).cast("double")
    if not size:
        nothing = F.lit(0).cast("long")
        return spark.range(1).select(F.lit(0).alias("order"), nothing.alias("hi"), nothing.alias("lo"), F.lit(1.0).alias("p"), none.alias("backoff"))
    kept = (F.col("n") - F.col("discount") + F.col("mass") * F.col("lower")) / F.col("total")
    first = _discounted(counts[1]).withColumn("lower", F.lit(1.0 / (size + 1)))
    levels = {1: cut(first.select("hi", "lo", kept.alias("p"), (F.col("mass") * F.col("lower") / F.col("total")).alias("none")))}
    for k in range(2, order + 1):
        below = levels[k - 1].select(F.col("hi").alias("end_hi"), F.col("lo").alias("end_lo"), F.col("p").alias("lower"))
        hi, lo = _ends(k)
        rows = _discounted(counts[k]).withColumn("end_hi", hi).withColumn("end_lo", lo).join(below, ["end_hi", "end_lo"])
        levels[k] = cut(rows.select("hi", "lo", "context_hi", "context_lo", kept.alias("p"), (F.col("mass") / F.col("total")).alias("left")))
    out = levels[1].limit(1).select(F.lit(0).alias("order"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"),
                                  F.col("none").alias("p"), none.alias("backoff"))
    for k in range(1, order):
        left = levels[k + 1].groupBy(F.col("context_hi").alias("hi"), F.col("context_lo").alias("lo")).agg(F.first("left").alias("left"))
        out = out.union(levels[k].select("hi", "lo", "p").join(left, ["hi", "lo"], "full").select(F.lit(k), "hi", "lo", "p", "left"))
    return out.union(levels[order].select(F.lit(order), "hi", "lo", "p", none))


def probabilities(wanted: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """hi, lo and p of the different n-grams ``wanted`` (hi, lo) of one order, by joins with a model of any order."""
    own = model.filter((F.col("order") == order) & F.col("p").isNotNull()).select("hi", "lo", "p")
    asked = wanted.join(own, ["hi", "lo"], "left")
    if order == 1:
        unseen = model.filter("order = 0").first().p
        return asked.select("hi", "lo", F.coalesce("p", F.lit(unseen)).alias("p"))
    asked = cut(asked)
    hi, lo = _ends(order)
    missing = asked.filter("p is null").select("hi", "lo", *_context(), hi.alias("end_hi"), lo.alias("end_lo"))
    ends = missing.select(F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo")).distinct()
    lower = probabilities(ends, model, order - 1).select(F.col("hi").alias("end_hi"), F.col("lo").alias("end_lo"), F.col("p").alias("lower"))
    left = model.filter((F.col("order") == order - 1) & F.col("backoff").isNotNull()).select(
        F.col("hi").alias("context_hi"), F.col("lo").alias("context_lo"), "backoff")
    p = F.coalesce("backoff", F.lit(1.0)) * F.col("lower")
    backed = missing.join(left, ["context_hi", "context_lo"], "left").join(lower, ["end_hi", "end_lo"]).select("hi", "lo", p.alias("p"))
    return asked.filter("p is not null").union(backed)


def _distinct(size: int):
    """The n-grams of the texts, each once for a slice."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(0).to_pylist()
            for own in _slices(texts, size):
                grams = Grams(texts[own])
                yield pa.record_batch([pa.array(grams.hi), pa.array(grams.lo)], ["hi", "lo"])

    return run


def _blocks(size: int):
    """Rows as blocks of compressed slices: block, part, rows. The number of a block stands for its content."""

    def block(place: str, held: list[bytes]) -> pa.RecordBatch:
        digest = hashlib.blake2b(place.encode(), digest_size=8)
        for part in held:
            digest.update(part)
        number = int.from_bytes(digest.digest(), "little", signed=True)
        return pa.record_batch([pa.array([number] * len(held), pa.int64()), pa.array(range(len(held)), pa.int32()),
                                pa.array(held, pa.binary())], ["block", "part", "rows"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, filled = TaskContext.get().partitionId(), 0, [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for part in parts:
            texts = part.column(2).to_pylist()
            for own in _slices(texts, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_batch(part.slice(own.start, own.stop - own.start))
                held.append(sink.getvalue().to_pybytes())
                filled += sum(len(t or "") for t in texts[own])
                if filled >= SLICES * size:
                    yield block(f"{task}-{made}", held)
                    made, held, filled = made + 1, [], 0
        if held:
            yield block(f"{task}-{made}", held)

    return run


class Block:
    """The n-grams of a block in order, each once. With ``keep`` also its rows without texts, and which n-grams stand where."""

    def __init__(self, rows: pa.Table, keep: bool):
        self.rows, self.grams, found = [], [], []
        for part in rows.sort_by("part")["rows"]:
            own = pa.ipc.open_stream(part.as_py()).read_all()
            grams = Grams(own.column(2).to_pylist())
            found.append((grams.hi, grams.lo))
            if keep:
                self.rows.append(own.select(["doc_id", "lang", "digest"]))
                self.grams.append(grams)
        hi, lo = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        new = np.concatenate([[True], (np.diff(hi) != 0) | (np.diff(lo) != 0)])[:len(hi)]
        place = np.empty(len(hi), np.int64)
        place[order] = np.cumsum(new) - 1
        self.hi, self.lo = hi[new], lo[new]
        self.places = np.split(place, np.cumsum([len(x) for x, _ in found])[:-1])


def _wanted(rows: pa.Table) -> pa.Table:
    block = Block(rows, keep=False)
    size = len(block.hi)
    return pa.table([pa.array(np.repeat(rows["block"][0].as_py(), size), pa.int64()), pa.array(np.arange(size), pa.int32()),
                     pa.array(block.hi), pa.array(block.lo)], ["block", "place", "hi", "lo"])


def _summed(rows: pa.Table, answers: pa.Table) -> pa.Table:
    block = Block(rows, keep=True)
    values = np.full(len(block.hi), np.nan)
    values[answers["place"].to_numpy()] = answers["loss"].to_numpy()
    if np.isnan(values).any():
        raise RuntimeError("a block met the n-grams of another reading of its texts; write the input as a table first")
    out = []
    for own, grams, places in zip(block.rows, block.grams, block.places, strict=True):
        count, loss = pa.array(grams.count, pa.int64()), pa.array(grams.sums(values[places]))
        out.append(pa.table([own["doc_id"], own["lang"], own["digest"], count, loss], ["doc_id", "lang", "digest", "n_tokens", "loss"]))
    return pa.concat_tables(out)


def losses(docs: DataFrame, model: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, lang, digest of the text, n_tokens and loss (negative log probability) of every text of ``docs``.

    One exchange of the blocks serves both for asking and for summing, so a block that is lost is made again for both.
    """
    rows = common.own_columns(docs, "doc_id", "lang", "text").select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), common.whole_text().alias("text"))
    known = cut(probabilities(rows.select("text").mapInArrow(_distinct(chunk_bytes), "hi long, lo long").distinct(), model))
    blocks = (rows.withColumn("digest", F.xxhash64("text"))
              .mapInArrow(_blocks(chunk_bytes), "block long, part int, rows binary"))
    wanted = blocks.groupBy("block").applyInArrow(_wanted, "block long, place int, hi long, lo long")
    answers = wanted.join(known, ["hi", "lo"]).select("block", "place", (-F.log("p")).alias("loss"))
    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(_summed, "doc_id long, lang string, digest long, n_tokens long, loss double"))


def classify(docs: DataFrame, labels: DataFrame, training_rows: int | None = None) -> DataFrame:
    """Perplexity and decision for every row, see ``judged``: doc_id, lang, n_tokens, perplexity, threshold, kept."""
    return judged(docs, labels, training_rows).drop("digest")


def judged(docs: DataFrame, labels: DataFrame, training_rows: int | None = None) -> DataFrame:
    """Perplexity and decision for every row of ``docs`` (doc_id, lang, text; other columns are ignored).

    ``labels`` has doc_id and quality (1: trusted); one in ``HELD_OUT`` trusted rows does not train the model, all others do unless
    ``training_rows`` bounds those of a language, and all held-out rows set the threshold. Returns
    doc_id, lang, digest (of the text), n_tokens, perplexity, threshold, kept. Null and empty texts are scored by their end only and
    are kept; a null language is a language of its own. With fewer than ``ENOUGH`` held-out documents the observed quantile is only
    their greatest value, which depends on their number; the threshold is then a normal tolerance limit. A language with fewer than ``LEAST`` has the widest spread of the others about its own median, one with none the highest median too; without any
    language that has a spread everything is kept. Rows with a null or repeated doc_id are scored one by one.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0
    model = cut(train(drawn(docs, good.filter(~held), training_rows), ORDER))
    scored = cut(losses(docs, model).withColumn("rate", F.col("loss") / F.col("n_tokens")))
    return decided(scored, cut(scored.join(good.filter(held), "doc_id", "left_semi")))


def drawn(docs: DataFrame, ids: DataFrame, most: int | None = None, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The texts of all rows with one of the different ``ids``; with ``most``, of a language with more rows about so many, chosen by hash.

    Texts stay where they lie while the chosen ids are few enough to be sent to them.
    """
    docs = common.own_columns(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    if most is None:
        ids = cut(ids)
        return docs.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", "left_semi").select("text")
    rows = docs.select("doc_id", "lang").join(ids, "doc_id", "left_semi")
    many = cut(rows.groupBy(F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    several = rows.join(many, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    share = F.coalesce(F.lit(float(most)) / F.col("n"), F.lit(1.0))
    # An id may be chosen for one of its languages and not for another; no more rows of it than ``most``, about, in any.
    first = F.pmod(F.xxhash64(F.lit("drawn"), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    chosen = cut(several.filter(first < share).groupBy("doc_id", F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("rows")))
    chosen = chosen.select(F.col("doc_id").alias("__id"), "__lang", "rows")
    if chosen.count() <= broadcast_ids:
        chosen = F.broadcast(chosen)
    met = docs.join(chosen, (F.col("doc_id") == F.col("__id")) & F.col("lang").eqNullSafe(F.col("__lang")))
    own = F.pmod(F.xxhash64(F.lit("row"), "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return met.filter(own < F.lit(float(most)) / F.col("rows")).select("text")


def decided(scored: DataFrame, unseen: DataFrame) -> DataFrame:
    """The decision for scored rows, by limits from the trusted ones that the model has not seen."""
    middles = cut(unseen.groupBy("lang").agg(F.percentile_approx("rate", 0.5, 10_000).alias("middle"))
                  .withColumnRenamed("lang", "__lang"))
    smooth = (F.col("loss") + PRIOR * F.col("middle")) / (F.col("n_tokens") + PRIOR)
    above = cut(unseen.join(middles, F.col("lang").eqNullSafe(F.col("__lang"))).select("__lang", "middle", (smooth - F.col("middle")).alias("above")))
    n, a = F.col("n"), 1 - SURE**2 / (2 * (F.col("n") - 1))
    factor = (UPPER + F.sqrt(UPPER**2 - a * (UPPER**2 - SURE**2 / n))) / a  # of a one-sided normal tolerance limit
    few = F.col("mean") + factor * F.col("deviation")
    limits = cut(above.groupBy("__lang", "middle").agg(
        F.percentile_approx("above", LEVEL, 10_000).alias("own"), F.count(F.lit(1)).alias("n"), F.avg("above").alias("mean"),
        F.stddev_samp("above").alias("deviation"))
                 .select("__lang", "middle", F.when(n >= ENOUGH, F.col("own")).when(n >= LEAST, few).alias("spread")))
    widest = limits.agg(F.max("middle").alias("middle"), F.max("spread").alias("spread")).first()
    m, spread = (F.coalesce(c, F.lit(widest[c]).cast("double")) for c in ("middle", "spread"))
    limit = m + spread + 1e-9
    rate = (F.col("loss") + PRIOR * m) / (F.col("n_tokens") + PRIOR)
    return (scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
            .select("doc_id", "lang", "digest", "n_tokens", F.exp("rate").alias("perplexity"), F.exp(limit).alias("threshold"),
                    F.coalesce(rate <= limit, F.lit(True)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``.

    A verdict belongs to a doc_id, a language and a text together (any of them may be null): rows that share only a
    doc_id do not decide for each other, rows equal in all three have the same verdict.
    """
    names = common.fresh(docs, "id", "none", "lang", "nolang", "digest", "n")
    verdict = judged(docs, labels, **options).filter("not kept")

    def key(digest, length) -> list:
        lang = F.col("`lang`").cast("string")
        parts = (F.coalesce(F.col("`doc_id`").cast("long"), F.lit(0)), F.col("`doc_id`").isNull(), F.coalesce(lang, F.lit("")),
                 lang.isNull(), digest, length)
        return [p.alias(n) for p, n in zip(parts, names, strict=True)]

    text = common.whole_text()
    marked = docs.select(*common.all_columns(docs), *key(F.xxhash64(text), (F.char_length(text) + 1).cast("long")))
    gone = verdict.select(*key(F.col("digest"), F.col("n_tokens"))).distinct()
    return marked.join(gone, names, "left_anti").select(*common.all_columns(docs))
