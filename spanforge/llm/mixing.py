"""Mixing sources to target weights by systematic sampling.

Sources by code point, null last, weigh 5, 2, 1, repeating, and share ``budget`` times all sizes; a target stops at
``most`` times its source's size and the excess is reshared by weight. Every document of a source has the same
expected copies, target / source size. Along the source's documents - ordered by size class, sub-class, size, hash -
the prefix sum of expected copies plus one random offset a source crosses integers; a document is taken once for each
integer crossed. As neighbours have like sizes, the words taken come near the target.

The prefix sum has two levels: counts of (source, size class, sub-class) are summed over at most some ten thousand
strata a source, and rows are numbered inside a stratum only; no task gets all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET, MOST, SEED, SUBCLASSES = 1.5, 2.0, "mix-1", 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """Eight classes for each power of two, by integers alone."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("CAST(shiftright(size, length(bin(size)) - 4) AS INT)") - 8).cast("int")


def targets(sizes: DataFrame, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, weight and target from (source, size) rows; one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * budget)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # If all sources before this one (by cap / weight) stop at their caps, the rest share so much a weight; the true level is the largest.
    level = ranked.withColumn("level", (F.col("total") - below) / above)
    level = level.withColumn("level", F.max("level").over(Window.partitionBy()))
    return level.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def hash_text(value: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(value.cast("string"), F.lit("-"))))


def systematic(sized: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``sized`` (with doc_id, source, size) and copies, source_size, target."""
    mine = plan.withColumn("mix_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    mine = mine.withColumn("mix_offset", F.conv(F.substring(hash_text(F.col("source"), seed), 1, 8), 16, 10).cast("double") / 4294967296.0)
    rows = sized.withColumn("mix_hash", hash_text(F.col("doc_id"), seed)).withColumn("mix_class", size_class(F.col("size")))
    rows = rows.withColumn("mix_sub", F.pmod(F.conv(F.substring("mix_hash", 1, 4), 16, 10).cast("int"), F.lit(SUBCLASSES))).withColumn("mix_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")))
    keys = ["mix_source", "mix_class", "mix_sub"]
    strata = rows.groupBy(*keys).agg(F.count("*").alias("mix_n"), F.first("source").alias("mix_name"))
    before = F.coalesce(F.sum("mix_n").over(Window.partitionBy("mix_source").orderBy("mix_class", "mix_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strata = strata.withColumn("mix_before", before)
    strata = strata.join(mine, strata.mix_name.eqNullSafe(mine.source)).select(*keys, "mix_before", "mix_rate", "mix_offset", "source_size", "target")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("size", "mix_hash", F.col("doc_id").asc_nulls_first()))
    numbered = rows.withColumn("mix_place", place).join(strata, keys)
    at = F.col("mix_before") + F.col("mix_place")
    crossed = F.floor(F.col("mix_offset") + at * F.col("mix_rate")) - F.floor(F.col("mix_offset") + (at - 1) * F.col("mix_rate"))
    return numbered.withColumn("copies", crossed.cast("bigint")).drop(*keys, "mix_hash", "mix_place", "mix_before", "mix_rate", "mix_offset")


def mix(docs: DataFrame, seed: str = SEED, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size x copies) of every row.

    A null text has size 0; rows of a null source form a source of its own, the last; a source of size 0 has target
    0 and takes nothing. Repeated rows are separate rows; which of two equal rows has a copy more is open, and the
    result the same either way. An empty table gives an empty one; other columns are ignored.
    """
    sized = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    out = systematic(sized, targets(sized, budget, most), seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document's columns once for each time it is taken, numbered in ``copy`` from 1.

    Columns named like those the operator makes (size, target, copies, copy ...) are kept as they were, but for ``copy``.
    """
    kept = [c for c in docs.columns if c != "copy"]
    packed = docs.select(F.struct(*kept).alias("row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    sizes = materialize(packed.select("source", "size"), "mix-sizes")
    out = systematic(packed, targets(sizes), seed).where("copies > 0")
    return out.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM by_source),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM ranked),
plan AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
hashed AS (SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-')) AS h, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) - 8 END AS class FROM sized),
placed AS (SELECT h.*, p.source_size, p.target, row_number() OVER (PARTITION BY h.source ORDER BY class, ('0x' || substr(h, 1, 4))::BIGINT % {SUBCLASSES}, size, h, doc_id NULLS FIRST) AS place,
  CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate, ('0x' || substr(md5('{SEED}|' || coalesce(h.source, '-')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM hashed h JOIN plan p ON h.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, (floor(start + place * rate) - floor(start + (place - 1) * rate))::BIGINT AS copies,
  size * (floor(start + place * rate) - floor(start + (place - 1) * rate))::BIGINT AS taken FROM placed
"""
