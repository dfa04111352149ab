"""Coverage pileups with run-length compression, FIRE scores and haplotype splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scalars import fire_weight
from spanforge.model import MIN_FIRE_COVERAGE, MIN_FIRE_QUALITY, MIN_MARK_QUALITY, PILEUP_WINDOW, ROLLING_WINDOW, SCORE_SCALE
from spanforge.operators.intervals import depth_runs, rle


@dataclass(frozen=True)
class PileupOptions:
    no_nuc: bool = False
    no_msp: bool = False
    m6a: bool = False
    cpg: bool = False
    haps: bool = False
    fiber_coverage: bool = False
    keep_zeros: bool = False
    per_base: bool = False
    min_fire_coverage: int = MIN_FIRE_COVERAGE
    window: int = PILEUP_WINDOW


def score(raw: Column, fire: Column, coverage: Column, least: int) -> Column:
    """Raw weights by coverage; -1 without enough FIRE coverage."""
    return F.when((fire <= 0) | (fire < least) | (coverage <= 0), -1.0).otherwise(raw / SCORE_SCALE / coverage)


def contributions(fibers: DataFrame, annotations: DataFrame, options: PileupOptions) -> DataFrame:
    """chrom, start, end, hp and what each interval adds to coverage, fire_coverage, raw, nuc, msp, m6a, cpg."""
    names = ("coverage", "fire_coverage", "raw", "nuc", "msp", "m6a", "cpg")
    row = lambda **added: [(added.get(n, F.lit(0))).cast("bigint").alias(n) for n in names]
    lifted = annotations.where("r_start is not null")
    if options.fiber_coverage:
        extent = lifted.where(F.col("type").isin("msp", "nuc")).groupBy("fiber_id").agg(F.min("r_start").alias("s"), F.max("r_end").alias("e"))
        spans = fibers.join(extent, "fiber_id").select("chrom", F.col("s").alias("start"), F.col("e").alias("end"), "hp", *row(coverage=F.lit(1)))
        lifted = lifted.join(extent.select("fiber_id"), "fiber_id", "left_semi")
    else:
        spans = fibers.select("chrom", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "hp", *row(coverage=F.lit(1)))
    fire = (F.col("type") == "msp") & (F.col("qual") >= MIN_FIRE_QUALITY)
    marked = lambda kind: ((F.col("type") == kind) & (F.col("qual") >= MIN_MARK_QUALITY)).cast("int")
    kinds = row(fire_coverage=fire.cast("int"), raw=F.when(fire, fire_weight(F.col("qual"))).otherwise(0), nuc=(F.col("type") == "nuc").cast("int"), msp=(F.col("type") == "msp").cast("int"), m6a=marked("m6a"), cpg=marked("cpg"))
    # a lifted element without width counts at one base
    own = lifted.select("chrom", F.col("r_start").alias("start"), F.greatest(F.col("r_end"), F.col("r_start") + 1).alias("end"), "hp", *kinds)
    return spans.unionByName(own)


def shown(options: PileupOptions) -> list[str]:
    """Columns of the track, apart from the score, that run-length compression compares."""
    kinds = ["coverage", "fire_coverage", *(["nuc"] if not options.no_nuc else []), *(["msp"] if not options.no_msp else []), *(["m6a"] if options.m6a else []), *(["cpg"] if options.cpg else [])]
    return [f"{k}{h}" for h in (("", "_h1", "_h2") if options.haps else ("",)) for k in kinds]


def depths(fibers: DataFrame, annotations: DataFrame, options: PileupOptions, contigs: DataFrame | None = None) -> DataFrame:
    """Runs with every track's sums and scores, before compression."""
    parts = contributions(fibers, annotations, options)
    names = ["coverage", "fire_coverage", "raw", "nuc", "msp", "m6a", "cpg"]
    if options.haps:
        parts = parts.select("*", *(F.when(F.col("hp") == h.upper(), F.col(n)).otherwise(0).alias(f"{n}_{h}") for h in ("h1", "h2") for n in names))
        names = names + [f"{n}_{h}" for h in ("h1", "h2") for n in names]
    parts = parts.select("chrom", "start", "end", *names)
    if options.keep_zeros and contigs is not None:
        parts = parts.unionByName(contigs.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), *(F.lit(0).cast("bigint").alias(n) for n in names)))
    runs = depth_runs(parts, names, options.window)
    for h in ("", "_h1", "_h2") if options.haps else ("",):
        runs = runs.withColumn(f"score{h}", score(F.col(f"raw{h}"), F.col(f"fire_coverage{h}"), F.col(f"coverage{h}"), options.min_fire_coverage))
    return runs if options.keep_zeros else runs.where("coverage > 0")


def pileup(fibers: DataFrame, annotations: DataFrame, options: PileupOptions = PileupOptions(), contigs: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """chrom, start, end and the tracks; ``raw`` sums stand for scores in comparisons, as they are whole numbers."""
    runs, same = depths(fibers, annotations, options, contigs), shown(options)
    haps = ("", "_h1", "_h2") if options.haps else ("",)
    out = rle(runs, [*same, *(f"score{h}" for h in haps)])
    if options.per_base:
        out = out.withColumn("start", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).withColumn("end", F.col("start") + 1)
    return out.select("chrom", "start", "end", *same, *(F.round(f"score{h}", 6).alias(f"score{h}") for h in haps))


def rolling_max(runs: DataFrame, window: int = ROLLING_WINDOW, tile: int = 100_000) -> DataFrame:
    """chrom, pos, score, rolling_max by base of scored runs (chrom, start, end, score).

    The window is [pos - w / 2, pos + w / 2); bases without a run count as -1. Tiles carry a halo of half a window, so
    each is a partition of its own.
    """
    half = window // 2
    bases = runs.where("score >= 0").select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "score", *(c for c in ("coverage", "fire_coverage") if c in runs.columns))
    low, high = F.expr(f"greatest(pos - {half}, 0) div {tile}"), F.expr(f"(pos + {half}) div {tile}")
    spread = bases.withColumn("tile", F.explode(F.sequence(low, high)))
    by = Window.partitionBy("chrom", "tile").orderBy("pos").rangeBetween(-half, half - 1)
    return spread.withColumn("rolling_max", F.max("score").over(by)).where(F.col("tile") == F.expr(f"pos div {tile}")).drop("tile")


def shuffled(fibers: DataFrame, places: DataFrame) -> DataFrame:
    """Fibers moved to the starts of ``places`` (chrom, fiber_id, ref_start, new_start); those without one go."""
    moved = fibers.join(places, ["chrom", "fiber_id", "ref_start"])
    return moved.withColumn("ref_end", F.col("new_start") + F.col("ref_end") - F.col("ref_start")).withColumn("ref_start", F.col("new_start")).drop("new_start")
