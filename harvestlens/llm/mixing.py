"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a number of words (``targets``). A document is first taken as many whole times as
its expected copies allow (the integer part of target / source size); what is left of the target is
filled by a Pareto sample: documents are ranked by the odds of a random number divided by the odds
of their inclusion probability, smallest first, until the words of the target are reached. The
sample has a fixed size in words: it ends at the document whose end or start is nearer to the target.

No source is sorted in one task. The ranking variable is cut into ``CELLS`` intervals, sizes are summed
per source and interval with map-side combining, and running totals over these few rows show in
which interval the target is reached. Only documents of that interval are ranked against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm import common
from harvestlens.session import cut

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
CELLS = 1 << 12
DIGITS = 13  # hexadecimal digits of the random number: 52 bits, exact in a double


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target words of each source of ``sizes`` (source, source_size).

    Sources in code point order (null last) weigh ``weights``, repeating, and share all words. A target
    stops at ``most`` times its source's size and the excess goes to the others by weight until none
    is above. That is a water level: target = min(most * size, level * weight), where sources reach
    their cap in the order of cap / weight.

    The running sums go over one row per source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
              .withColumn("cap", most * F.col("source_size"))
              .withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    by_ratio = Window.orderBy("ratio", "place")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).cast("double")
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    first = ranked.withColumn("level", level).withColumn(
        "final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(whole))
    return first.select("source", "source_size",
                        F.least(F.col("cap").cast("double"), F.col("final.level") * F.col("weight")).alias("target"))


def random_number(seed: int):
    """A number in [0, 1) that depends on the doc_id only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns one row per input row: doc_id, size (words), source_size, target (of its source), copies,
    taken (copies * size). A null text has no words, a null source is a source of its own and comes
    last, a null doc_id is drawn like any other id; rows with equal doc_id, source and size are
    interchangeable. Documents without words are taken zero times; an empty table gives no rows.
    """
    words = F.size(F.regexp_extract_all(common.whole_text(), F.lit(common.WORD), F.lit(0)))
    sized = cut(common.own_columns(docs, "doc_id", "source", "text")
                .select("doc_id", "source", words.cast("long").alias("size"), random_number(seed).alias("u")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most).withColumnsRenamed({"source": "__source"})
    at_source = F.col("source").eqNullSafe(F.col("__source"))
    expected = F.col("target") / F.col("source_size")
    has_words = F.col("source_size") > 0
    goal = cut(goal.withColumn("sure", F.when(has_words, F.floor(expected)).otherwise(F.lit(0)))
               .withColumn("share", F.when(has_words, expected - F.col("sure")).otherwise(F.lit(0.0)))
               .withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size")))
    odds = F.when(F.col("share") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("share") / (1 - F.col("share"))))
    ranked = (sized.join(goal, at_source).withColumn("q", odds)
              .withColumn("cell", F.floor(F.col("q") / (1 + F.col("q")) * CELLS)))

    per_cell = (ranked.filter("share > 0").groupBy("__source", "cell")
                .agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    up_to = Window.partitionBy("__source").orderBy("cell")
    reached = (per_cell.withColumn("end", F.sum("words").over(up_to)).filter(F.col("end") > F.col("rest"))
               .groupBy(F.col("__source").alias("__s"))
               .agg(F.min(F.struct("cell", (F.col("end") - F.col("words")).alias("before"))).alias("stop")))
    placed = ranked.join(reached, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    border = (F.col("cell") == F.col("stop.cell"))
    inside = F.when((F.col("share") > 0) & (F.col("stop").isNull() | (F.col("cell") < F.col("stop.cell"))),
                    F.lit(1)).otherwise(F.lit(0))
    order = Window.partitionBy("source").orderBy("q", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("stop.before") + F.sum("size").over(order)) - F.col("size")
    clear = placed.filter(~F.coalesce(border, F.lit(False))).withColumn("extra", inside)
    close = placed.filter(border).withColumn("extra", F.when(middle <= 2 * F.col("rest"), F.lit(1)).otherwise(F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    return (clear.unionByName(close).withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def take(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of ``docs``, a document taken k times as k rows."""
    i, none, source, gone, size, copies, rows, n, own, copy = names = common.fresh(
        docs, "id", "none", "source", "gone", "size", "copies", "rows", "n", "own", "copy")
    names = names[:5]
    key = [F.coalesce("doc_id", F.lit(0)).alias(i), F.col("doc_id").isNull().alias(none),
           F.coalesce("source", F.lit("")).alias(source), F.col("source").isNull().alias(gone)]
    words = F.size(F.regexp_extract_all(common.whole_text(), F.lit(common.WORD), F.lit(0))).cast("long").alias(size)
    plan = (mix(docs, **options).filter("copies > 0").select(*key, F.col("size").alias(size), F.col("copies").alias(copies))
            .groupBy(*names).agg(F.sum(copies).alias(copies), F.count(F.lit(1)).alias(rows)))
    # Rows with the same doc_id, source and size share their copies in turn, in an order that their texts fix.
    number = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(common.whole_text()), F.hash(common.whole_text())))
    share = F.floor(F.col(copies) / F.col(rows)) + (F.col(n) <= F.col(copies) % F.col(rows)).cast("int")
    return (docs.select(*common.all_columns(docs), *key, words).join(plan, names).withColumn(n, number)
            .withColumn(own, share.cast("int")).filter(F.col(own) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*common.all_columns(docs)))
