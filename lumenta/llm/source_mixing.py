"""Mixing sources to target weights.

Tokens are summed per source; every source gets a target from its weight, and a repetition
rate = target / tokens.  A document is emitted floor(rate) times, plus one copy more when a
hash of its id, as a number in [0, 1), lies below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, table

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix-1"


def draw(id_col: str, text_col: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) from the id, or from the text where there is none; 48 bits of an MD5,
    so any engine can repeat it."""
    own = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), own))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def token_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from (source, size), one row per source.

    Weights repeat over the sources in code point order, null last.  What a source cannot
    take beyond max_rate times its size is shared again by weight: in the order of limit per
    weight, a source is at its limit if the level that the sources from it on would share
    reaches that far.  One row per source is sorted in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_rate)
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("used"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.sum("source_size").over(everything).alias("total"),
        F.row_number().over(by_level).alias("place"),
    ).withColumn("full", (F.col("total") - F.col("used")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    # the first source that is not full fixes the level for itself and all after it
    level = per.filter(~F.col("full")).agg(F.min_by(F.struct("used", "weight_left", "total"), "place").alias("at"), F.min("place").alias("from"))
    target = F.when(F.col("from").isNull() | (F.col("place") < F.col("from")), F.col("cap").cast("double")).otherwise(
        F.col("weight") * (F.col("at.total") - F.col("at.used")).cast("double") / F.col("at.weight_left")
    )
    return (
        per.join(F.broadcast(level))  # one row
        .withColumn("target", target)
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with _lm_size, _lm_source_size, _lm_target and _lm_copies added."""
    sized = docs.withColumn("_lm_size", token_count(text_col))
    per = durable(targets(sized.select(F.col(source_col).alias("source"), F.col("_lm_size").alias("size"))), "mix-targets")
    per = per.select(F.col("source").alias("_lm_s"), F.col("source_size").alias("_lm_source_size"), F.col("target").alias("_lm_target"), F.col("rate").alias("_lm_rate"))
    whole = F.floor("_lm_rate")
    copies = whole + F.when(draw(id_col, text_col) < F.col("_lm_rate") - whole, 1).otherwise(0)
    return sized.join(per, F.col(source_col).eqNullSafe(F.col("_lm_s"))).withColumn("_lm_copies", copies.cast("long")).drop("_lm_s", "_lm_rate")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it (0 to 3 times), with its own columns.

    A null text has size 0; a text of any length counts whole; sources are compared as they
    are, null is one of its own.  Rows that repeat an id draw the same number; rows without an
    id draw by their text, so that they do not all come or go together.  No rows give no rows;
    a source without tokens has target and rate 0 and is not taken.  Extra columns are kept,
    but for names that begin with _lm_, which the operator uses.
    """
    mixed = plan(docs, id_col, text_col, source_col)
    return mixed.withColumn("_lm_copy", F.explode(F.array_repeat(F.lit(0), F.col("_lm_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    mixed = plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("_lm_size").alias("size"), F.col("_lm_source_size").alias("source_size"), F.col("_lm_target").alias("target"), (F.col("_lm_size") * F.col("_lm_copies")).alias("taken")
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS own, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
t AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
         row_number() OVER o AS place,
         coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weight_left
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST)),
f AS (
  SELECT place, used, weight_left FROM t
  WHERE (total - used) * weight < cap * weight_left ORDER BY place LIMIT 1),
g AS (
  SELECT t.source, source_size,
         CASE WHEN f.place IS NULL OR t.place < f.place THEN cap::DOUBLE
              ELSE weight * (total - f.used)::DOUBLE / f.weight_left END AS target
  FROM t LEFT JOIN f ON true),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || d.own), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
