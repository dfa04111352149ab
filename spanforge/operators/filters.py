"""Filters on fibers and on array elements, and the element expression language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CALL = re.compile(r"^(len|qual)\((msp|nuc|m6a|5mC|cpg)\)(!=|>=|<=|>|<|=)(-?\d+(?:\.\d+)?)(?::(-?\d+(?:\.\d+)?))?$")
_TYPES = {"5mC": "cpg"}


def parse_expression(text: str) -> list[tuple[str, str, str, float, float | None]]:
    """``func(type)OP value[:value]``, comma-separated; ranges only with =. ValueError otherwise."""
    out = []
    for part in re.sub(r"\s+", "", text).split(","):
        m = _CALL.match(part)
        if not m or (m[5] is not None and m[3] != "="):
            raise ValueError(f"no such filter: {part}")
        out.append((m[1], _TYPES.get(m[2], m[2]), m[3], float(m[4]), None if m[5] is None else float(m[5])))
    return out


def _holds(value: Column, op: str, low: float, high: float | None) -> Column:
    if high is not None:
        return (value >= low) & (value < high)
    return {"!=": value != low, ">=": value >= low, "<=": value <= low, ">": value > low, "<": value < low, "=": value == low}[op]


def expression(annotations: DataFrame, text: str) -> DataFrame:
    """Elements (type, length, qual) that pass every filter of their type; other types stay."""
    keep = F.lit(True)
    for func, kind, op, low, high in parse_expression(text):
        keep = keep & ((F.col("type") != kind) | _holds(F.col("length" if func == "len" else "qual"), op, low, high))
    return annotations.where(keep)


def bit_flag(fibers: DataFrame, mask: int) -> DataFrame:
    return fibers.where(F.col("flag").bitwiseAND(F.lit(mask)) == 0)


def hard_clipped_with_marks(fibers: DataFrame) -> DataFrame:
    """Fibers without those that are hard-clipped and carry base modifications (cigar, tags)."""
    return fibers.where(~(F.col("cigar").rlike(r"\d+H") & F.map_contains_key("tags", F.lit("MM")) & F.map_contains_key("tags", F.lit("ML"))))


def min_quality(annotations: DataFrame, least: int = 125) -> DataFrame:
    return annotations.where(~F.col("type").isin("m6a", "cpg") | (F.col("qual") >= least))


def strip_ends(annotations: DataFrame, strip: int) -> DataFrame:
    return annotations.where(~F.col("type").isin("m6a", "cpg") | ((F.col("fwd_start") >= strip) & (F.col("fwd_start") < F.col("read_length") - strip)))


def away_from_ends(annotations: DataFrame, distance: int = 45) -> DataFrame:
    return annotations.where(~F.col("type").isin("nuc", "msp") | ((F.col("fwd_start") >= distance) & (F.col("fwd_start") + F.col("length") <= F.col("read_length") - distance)))


def fire_fibers(fibers: DataFrame, annotations: DataFrame, need_m6a: bool = True, min_msp: int = 10, min_ave: int = 10) -> DataFrame:
    """Fibers with an msp, optionally an m6a, enough msps and a whole mean msp length that is enough."""
    stats = annotations.groupBy("fiber_id").agg(F.count_if(F.col("type") == "msp").alias("n"), F.count_if(F.col("type") == "m6a").alias("m"), F.sum(F.when(F.col("type") == "msp", F.col("length")).otherwise(0)).alias("t"))
    keep = stats.where((F.col("n") >= max(1, min_msp)) & ((F.col("m") > 0) | F.lit(not need_m6a))).where(F.expr(f"CASE WHEN n > 0 THEN t div n >= {min_ave} ELSE false END"))
    return fibers.join(keep.select("fiber_id"), "fiber_id", "left_semi")


def strip_basemods(annotations: DataFrame, drop: str | None = None, min_quality: int = 0, strand: str | None = None) -> DataFrame:
    """Without marks of type ``drop``, below a quality, or of a strand."""
    mark = F.col("type").isin("m6a", "cpg")
    gone = (F.col("qual") < min_quality) | (F.col("type") == F.lit(drop) if drop else F.lit(False)) | (F.col("strand") == F.lit(strand) if strand else F.lit(False))
    return annotations.where(~(mark & gone))


def retain(annotations: DataFrame, kind: str, predicate: Column) -> DataFrame:
    return annotations.where((F.col("type") != kind) | predicate)
