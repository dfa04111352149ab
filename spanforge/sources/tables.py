"""Fibers, annotations, regions, centers and marks projected from the driver's tables; whole numbers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.coords import flip, lift_range


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fibers(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, length = (F.col("o_orderkey") * 97) % 20000, F.lit(2000) + (F.col("o_custkey") * 13) % 3000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fiber_id"),
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"),
        start.alias("ref_start"),
        (start + length).alias("ref_end"),
        length.alias("read_length"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.when(F.col("o_orderstatus") == "F", "H1").when(F.col("o_orderstatus") == "O", "H2").otherwise("UNK").alias("hp"),
        (F.col("o_custkey") % 4096).cast("int").alias("flag"),
    )


def with_blocks(fibers: DataFrame) -> DataFrame:
    """Aligned blocks: a 50-base deletion at 1000, a 40-base insertion at 900, or one block, by id."""
    block = lambda q0, q1, r0: F.struct(F.lit(q0).cast("bigint").alias("q_start"), q1.cast("bigint").alias("q_end"), r0.cast("bigint").alias("r_start"))
    n, r, kind = F.col("read_length"), F.col("ref_start"), F.col("fiber_id") % 3
    deleted = F.array(block(0, F.lit(1000), r), block(1000, n, r + 1050))
    inserted = F.array(block(0, F.lit(900), r), block(940, n, r + 900))
    return fibers.withColumn("blocks", F.when(kind == 0, deleted).when(kind == 1, inserted).otherwise(F.array(block(0, n, r))))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations in the molecule's frame: fiber_id, type, fwd_start, length, qual."""
    kind = F.when(F.col("l_returnflag") == "A", "nuc").when(F.col("l_returnflag") == "N", "msp").otherwise("m6a")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fiber_id"),
        kind.alias("type"),
        ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7) % 1800).alias("fwd_start"),
        F.when(kind == "m6a", F.lit(1)).otherwise(F.col("l_quantity").cast("bigint") * 3).cast("bigint").alias("length"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 256).cast("int").alias("qual"),
    )


def cpg_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of a fourth type, from the events."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select((e % 997 + 1).alias("fiber_id"), F.lit("cpg").alias("type"), ((e * 37 + u * 11) % 1800).alias("fwd_start"), F.lit(1).cast("bigint").alias("length"), ((e * 5 + u) % 256).cast("int").alias("qual"))


def annotations(spark: SparkSession, sf_dir: str, blocks: bool = False, cpg: bool = False) -> DataFrame:
    """``marks`` (and ``cpg_marks``) with the fiber's columns, the query frame (q_start, q_end) and the reference frame (r_start, r_end)."""
    own = fibers(spark, sf_dir)
    found = marks(spark, sf_dir).unionByName(cpg_marks(spark, sf_dir)) if cpg else marks(spark, sf_dir)
    joined = found.join(with_blocks(own) if blocks else own, "fiber_id")
    q = flip(F.col("fwd_start"), F.col("fwd_start") + F.col("length"), F.col("read_length"), F.col("strand"))
    framed = joined.withColumn("q_start", q[0]).withColumn("q_end", q[1])
    if not blocks:
        return framed.withColumn("r_start", F.col("ref_start") + F.col("q_start")).withColumn("r_end", F.col("ref_start") + F.col("q_end"))
    lifted = framed.withColumn("lifted", lift_range(F.col("blocks"), F.col("q_start"), F.col("q_end")))
    return lifted.withColumn("r_start", F.col("lifted.start")).withColumn("r_end", F.col("lifted.end")).drop("lifted")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("p_partkey") * 53) % 22000
    return table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 100 + F.col("p_size")).alias("end"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("region_id"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), (F.col("s_suppkey") % 5 + 1).cast("string")).alias("chrom"), ((F.col("s_suppkey") * 211) % 22000).alias("pos"), F.when(F.col("s_nationkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("s_suppkey").alias("center_id"))


#: The same projection for DuckDB, as common table expressions.
SQL = """
fibers AS (SELECT o_orderkey AS fiber_id, 'chr' || (o_custkey % 5 + 1) AS chrom, (o_orderkey * 97) % 20000 AS ref_start, (o_orderkey * 97) % 20000 + 2000 + (o_custkey * 13) % 3000 AS ref_end,
  2000 + (o_custkey * 13) % 3000 AS read_length, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE o_orderstatus WHEN 'F' THEN 'H1' WHEN 'O' THEN 'H2' ELSE 'UNK' END AS hp, (o_custkey % 4096)::INTEGER AS flag FROM orders),
marks AS (SELECT l_orderkey AS fiber_id, CASE l_returnflag WHEN 'A' THEN 'nuc' WHEN 'N' THEN 'msp' ELSE 'm6a' END AS type, (l_partkey * 31 + l_suppkey * 7) % 1800 AS fwd_start,
  CASE WHEN l_returnflag IN ('A', 'N') THEN l_quantity::BIGINT * 3 ELSE 1 END AS length, ((l_partkey * 7 + l_suppkey * 3) % 256)::INTEGER AS qual FROM lineitem),
flipped AS (SELECT m.*, f.chrom, f.ref_start, f.ref_end, f.read_length, f.strand, f.hp, CASE WHEN strand = '-' THEN read_length - fwd_start - length ELSE fwd_start END AS q_start, CASE WHEN strand = '-' THEN read_length - fwd_start ELSE fwd_start + length END AS q_end FROM marks m JOIN fibers f USING (fiber_id)),
annotations AS (SELECT *, ref_start + q_start AS r_start, ref_start + q_end AS r_end FROM flipped),
blocks AS (SELECT fiber_id, unnest(CASE fiber_id % 3 WHEN 0 THEN [{'a': 0, 'b': 1000, 'r': ref_start}, {'a': 1000, 'b': read_length, 'r': ref_start + 1050}] WHEN 1 THEN [{'a': 0, 'b': 900, 'r': ref_start}, {'a': 940, 'b': read_length, 'r': ref_start + 900}] ELSE [{'a': 0, 'b': read_length, 'r': ref_start}] END, recursive := true) FROM fibers),
regions AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, (p_partkey * 53) % 22000 AS start, (p_partkey * 53) % 22000 + 100 + p_size AS "end", p_brand AS name, p_partkey AS region_id FROM part),
centers AS (SELECT 'chr' || (s_suppkey % 5 + 1) AS chrom, (s_suppkey * 211) % 22000 AS pos, CASE WHEN s_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand, s_suppkey AS center_id FROM supplier)
"""
