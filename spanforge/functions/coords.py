"""Coordinate frames as column expressions: flip, lift between molecule and reference, anchored projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flip(start: Column, end: Column, length: Column, strand: Column) -> tuple[Column, Column]:
    """[start, end) of a molecule in the query frame: reversed for '-'."""
    back = strand == "-"
    return F.when(back, length - end).otherwise(start), F.when(back, length - start).otherwise(end)


def lift_range(blocks: Column, start: Column, end: Column) -> Column:
    """struct<start, end> on the reference, NULL if no aligned base is in [start, end).

    Starts snap forward and ends backward to aligned bases; ``blocks`` are array<struct<q_start, q_end, r_start>>.
    """
    hit = F.filter(blocks, lambda b: (b["q_start"] < end) & (b["q_end"] > start))
    low = F.array_min(F.transform(hit, lambda b: b["r_start"] + F.greatest(start, b["q_start"]) - b["q_start"]))
    high = F.array_max(F.transform(hit, lambda b: b["r_start"] + F.least(end, b["q_end"]) - b["q_start"]))
    return F.when((F.size(hit) > 0) & (low < high), F.struct(low.alias("start"), high.alias("end")))


def lift_point(blocks: Column, pos: Column) -> Column:
    """Reference position of one aligned base, else NULL."""
    return F.get(F.transform(F.filter(blocks, lambda b: (b["q_start"] <= pos) & (pos < b["q_end"])), lambda b: b["r_start"] + pos - b["q_start"]), F.lit(0))


def lift_inverse(blocks: Column, start: Column, end: Column) -> Column:
    """struct<start, end> on the molecule of a reference range: ``lift_range`` with the roles swapped."""
    swapped = F.transform(blocks, lambda b: F.struct(b["r_start"].alias("q_start"), (b["r_start"] + b["q_end"] - b["q_start"]).alias("q_end"), b["q_start"].alias("r_start")))
    return lift_range(swapped, start, end)


def project(start: Column, end: Column, anchor: Column, back: Column) -> tuple[Column, Column]:
    """[start, end) relative to ``anchor``; half-open-safe negation where ``back``."""
    return F.when(back, -(end - anchor) + 1).otherwise(start - anchor), F.when(back, -(start - anchor) + 1).otherwise(end - anchor)


def cigar_blocks(cigar: Column, ref_start: Column) -> Column:
    """Aligned blocks of a CIGAR: M, = and X align; I and S use the query, D and N the reference; H and P neither."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0)), lambda o: F.struct(F.substring(o, 1, 20).alias("o"), F.regexp_extract(o, r"(\d+)", 1).cast("bigint").alias("n"), F.right(o, F.lit(1)).alias("k")))
    empty = F.array().cast("array<struct<q_start:bigint,q_end:bigint,r_start:bigint>>")
    first = F.struct(F.lit(0).cast("bigint").alias("q"), ref_start.cast("bigint").alias("r"), empty.alias("out"))

    def step(acc: Column, op: Column) -> Column:
        aligned, n = op["k"].isin("M", "=", "X"), op["n"]
        one = F.array(F.struct(acc["q"].alias("q_start"), (acc["q"] + n).alias("q_end"), acc["r"].alias("r_start")))
        return F.struct(
            (acc["q"] + F.when(aligned | op["k"].isin("I", "S"), n).otherwise(0)).alias("q"),
            (acc["r"] + F.when(aligned | op["k"].isin("D", "N"), n).otherwise(0)).alias("r"),
            F.when(aligned, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ops, first, step, lambda acc: acc["out"])
