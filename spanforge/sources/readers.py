"""Readers and writers of the text formats: BED, centers, motifs, FASTA, FDR tables, SAM; region strings."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REGION = re.compile(r"^([^:]+)(?::([\d,]+)-([\d,]+))?$")


def region(text: str) -> tuple[str, int | None, int | None]:
    """chr:1,000-2,000 or chr."""
    m = _REGION.match(text.strip())
    if not m:
        raise ValueError(f"no region: {text}")
    number = lambda x: None if x is None else int(x.replace(",", ""))
    return m[1], number(m[2]), number(m[3])


def in_region(fibers: DataFrame, text: str) -> DataFrame:
    chrom, start, end = region(text)
    rows = fibers.where(F.col("chrom") == chrom)
    return rows if start is None else rows.where((F.col("ref_start") < end) & (F.col("ref_end") > start))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name (null if empty), extra; '#' lines and blank ones are skipped; .gz is read."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(parts.alias("p"))
    name = F.get("p", F.lit(3))
    return rows.select(F.get("p", F.lit(0)).alias("chrom"), F.get("p", F.lit(1)).cast("bigint").alias("start"), F.get("p", F.lit(2)).cast("bigint").alias("end"), F.when(name != "", name).alias("name"), F.slice("p", 5, 100000).alias("extra"))


def region_name(name: Column, chrom: Column, start: Column, end: Column) -> Column:
    return F.coalesce(name, F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def centers(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, strand: column 6, or 4 if that is the strand; '-' centers stand on the last base."""
    rows = bed(spark, path)
    strand = F.when((F.get("extra", F.lit(1)) == "-") | (F.col("name") == "-"), "-").otherwise("+")
    return rows.select("chrom", F.when(strand == "-", F.col("end") - 1).otherwise(F.col("start")).alias("pos"), strand.alias("strand"))


def modules(text: str) -> list[tuple[int, int]]:
    """Of a footprint file's ``modules: [[0, 8], [8, 16]]``: contiguous, sorted, from 0."""
    found = json.loads(re.search(r"modules\s*:\s*(\[[\s\S]*?\]\s*\])", text)[1])
    out = [(int(a), int(b)) for a, b in found]
    if not out or out[0][0] != 0 or any(a[1] != b[0] for a, b in zip(out, out[1:])) or any(a >= b for a, b in out):
        raise ValueError("modules must be contiguous, sorted, and start at 0")
    return out


def motifs(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    """Motif intervals, each as long as the modules together."""
    rows = bed(spark, path)
    strand = F.coalesce(F.get("extra", F.lit(1)), F.lit("+"))
    fits = F.assert_true(F.col("end") - F.col("start") == parts[-1][1], "a motif of another length").isNull()
    return rows.where(fits).select("chrom", "start", (F.col("end") - 1).alias("end"), strand.alias("strand"), F.xxhash64("chrom", "start", "end").alias("motif_id"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of each record."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "").alias("seq"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("chrom string, length bigint, offset bigint, line_bases int, line_width int").csv(path).select("chrom", "length")


def fdr_table(spark: SparkSession, path: str) -> DataFrame:
    """Exactly four columns; the header is skipped; any other row is an error."""
    schema = "threshold double, fdr double, shuffled_bp double, real_bp double"
    return spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST").schema(schema).csv(path).orderBy("threshold")


def write_fdr_table(table: DataFrame, path: str) -> None:
    table.select(*(F.format_string(f, c).alias(n) for f, c, n in (("%.2f", "threshold", "threshold"), ("%.6f", "fdr", "FDR"), ("%.0f", "shuffled_bp", "shuffled_bp"), ("%.0f", "real_bp", "real_bp")))).write.option("sep", "\t").option("header", True).csv(path)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Fibers from SAM text: the eleven fields, tags as a map, RG '.', HP as H{n} or UNK."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '@%' and value <> ''").select(parts.alias("p"))
    tags = F.map_from_entries(F.transform(F.slice("p", 12, 100000), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    rows = rows.withColumn("tags", tags)
    flag = F.col("p")[1].cast("int")
    return rows.select(F.col("p")[0].alias("fiber_id"), flag.alias("flag"), F.when(F.col("p")[2] != "*", F.col("p")[2]).alias("chrom"), (F.col("p")[3].cast("bigint") - 1).alias("ref_start"), F.when(flag.bitwiseAND(F.lit(16)) > 0, "-").otherwise("+").alias("strand"), F.col("p")[4].cast("int").alias("mapq"), F.col("p")[5].alias("cigar"), F.col("p")[9].alias("seq"), F.col("p")[10].alias("qual"), F.length(F.col("p")[9]).alias("read_length"), F.coalesce(F.try_element_at("tags", F.lit("RG")), F.lit(".")).alias("rg"), F.coalesce(F.concat(F.lit("H"), F.try_element_at("tags", F.lit("HP"))), F.lit("UNK")).alias("hp"), F.coalesce(F.try_element_at("tags", F.lit("ec")).cast("float"), F.lit(0.0).cast("float")).alias("ec"), "tags")


def write_bed(df: DataFrame, path: str, compress: bool = False) -> None:
    """Tab-separated text with a '#' header line a file."""
    names = list(df.columns)
    df.select(F.col(names[0]).alias(f"#{names[0]}"), *names[1:]).write.option("sep", "\t").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def shuffled_fibers(spark: SparkSession, path: str) -> DataFrame:
    """chrom, fiber_id, ref_start, new_start from lines of chrom, new start, new end, name, original start; '#' lines are skipped.

    A line of fewer fields, or whose starts are no numbers, is an error. Of lines alike in chrom, name and original start
    one stands, the greatest new start.
    """
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '#%' and value <> ''").select(parts.alias("p"))
    whole = F.assert_true(F.size("p") >= 5, "a line of fewer than five fields").isNull()
    rows = rows.where(whole).select(F.col("p")[0].alias("chrom"), F.col("p")[3].alias("fiber_id"), F.col("p")[4].cast("bigint").alias("ref_start"), F.col("p")[1].cast("bigint").alias("new_start"))
    return rows.groupBy("chrom", "fiber_id", "ref_start").agg(F.max("new_start").alias("new_start"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """type and line (the fields behind the type) of each header record of SAM text."""
    rows = spark.read.text(path).where("value like '@%'")
    return rows.select(F.substring("value", 2, 2).alias("type"), F.expr("substring(value, 5)").alias("line"))


def header_text(headers: DataFrame) -> DataFrame:
    """value: the records (type, line) as header lines, HD first."""
    return headers.orderBy(F.when(F.col("type") == "HD", 0).otherwise(1), "type", "line").select(F.concat(F.lit("@"), "type", F.lit("\t"), "line").alias("value"))
