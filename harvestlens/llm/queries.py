"""The operators of this package over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm import byte_bpe, common, exact_dedup, hard_negatives, html_extract, language_model, mixing, near_dedup, neighbours, periodic_runs, quality, sentence_piece, substring_dedup, toxicity
from harvestlens.session import tune

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(tune(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op2_exact_dedup", """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(text) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY text)""")
def op2_exact_dedup(spark, folder):
    docs = common.table(spark, folder, "documents")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_mixing", r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
        FROM documents),
    named AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
        FROM sized GROUP BY source),
    weighed AS (
        SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap
        FROM named),
    levels AS (
        SELECT *, cap::DOUBLE / weight AS ratio,
               (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
               / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
        FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, place
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    goal AS (
        SELECT source, source_size, least(cap::DOUBLE, (
                   SELECT arg_min(level, (ratio, place)) FROM levels WHERE level <= ratio) * weight) AS target
        FROM levels),
    parts AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS sure FROM goal),
    shares AS (
        SELECT *, CASE WHEN source_size > 0 THEN target / source_size - sure ELSE 0 END AS share,
               target - sure * source_size AS rest
        FROM parts),
    ranked AS (
        SELECT s.*, g.source_size, g.target, g.sure, g.share, g.rest,
               CASE WHEN share > 0 THEN (u / (1 - u)) / (share / (1 - share)) END AS q
        FROM sized s JOIN shares g ON s.source IS NOT DISTINCT FROM g.source),
    chosen AS (
        SELECT *, CASE WHEN share > 0 AND 2 * sum(size) OVER (
                      PARTITION BY source ORDER BY q, u, doc_id, size ROWS UNBOUNDED PRECEDING) - size <= 2 * rest
                  THEN 1 ELSE 0 END AS extra
        FROM ranked)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (CASE WHEN size > 0 THEN (sure + extra) * size ELSE 0 END)::BIGINT AS taken
    FROM chosen""")
def op5_mixing(spark, folder):
    return (mixing.mix(common.table(spark, folder, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


@query("op4_byte_bpe")
def op4_byte_bpe(spark, folder):
    import public_tokenizers

    return byte_bpe.encode(common.table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY),
                           public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op7_near_dedup")
def op7_near_dedup(spark, folder):
    return near_dedup.near_groups(common.table(spark, folder, "documents"))


@query("op1_quality")
def op1_quality(spark, folder):
    return quality.classify(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))


def remainder(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


@query("op3_toxicity")
def op3_toxicity(spark, folder):
    docs = common.table(spark, folder, "documents")
    labels = common.table(spark, folder, "labels").filter(remainder(5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


@query("op10_language_model")
def op10_language_model(spark, folder):
    docs = common.table(spark, folder, "documents")
    model = language_model.train(docs.filter(remainder(5) != 1))
    return language_model.score(docs, model).select(
        "doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_substring_dedup")
def op6_substring_dedup(spark, folder):
    return substring_dedup.remove_repeats(common.table(spark, folder, "documents"), text=False)


@query("op9_nearest_neighbours")
def op9_nearest_neighbours(spark, folder):
    return neighbours.nearest(common.table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_html_extract")
def op8_html_extract(spark, folder):
    return html_extract.main_text(common.table(spark, folder, "pages"))


@query("op13_sentence_piece")
def op13_sentence_piece(spark, folder):
    import public_tokenizers

    return sentence_piece.encode(common.table(spark, folder, "documents"), public_tokenizers.path(PIECES),
                                 ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, folder):
    return periodic_runs.periodic_runs(
        common.table(spark, folder, "documents"),
        ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"), prepare=periodic_runs.plant)


@query("op11_hard_negatives", """
    WITH usable AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS x
        FROM embeddings),
    rows AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, label, list_transform(x, lambda c: floor(256 * c)) AS v FROM usable
        WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scored AS MATERIALIZED (
        SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
               list_inner_product(a.v, b.v)::BIGINT AS score
        FROM rows a JOIN rows b ON len(a.v) = len(b.v) AND a.row <> b.row WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score,
           n.score AS negative_score
    FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
         AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
    WINDOW w AS (PARTITION BY p.anchor, positive ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row)
    QUALIFY row_number() OVER w <= 5""")
def op11_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(common.table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
