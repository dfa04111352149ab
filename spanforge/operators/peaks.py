"""FDR tables from real and shuffled scores, islands of local maxima, peak merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(runs: DataFrame, is_real: bool) -> DataFrame:
    """Bases by score; additive over chromosomes."""
    return runs.where("score >= 0").groupBy("score").agg(F.sum(F.col("end") - F.col("start")).alias("bp")).withColumn("is_real", F.lit(is_real))


def fdr_table(scores: DataFrame) -> DataFrame:
    """threshold, fdr, shuffled_bp, real_bp from (score, bp, is_real).

    Cumulative bases from the highest score down, for every distinct score but the lowest; a sentinel at -1; then rows
    alike in fdr (millionths), shuffled bases, real bases and threshold (hundredths) keep their last, each in the order
    of the step before. Sums run inside hundredths of a score, and along hundredths: a row each, however many scores
    there are.
    """
    whole = scores.where("score >= 0").groupBy("score").agg(F.sum(F.when(F.col("is_real"), F.col("bp")).otherwise(0)).alias("r"), F.sum(F.when(F.col("is_real"), 0).otherwise(F.col("bp"))).alias("v"))
    whole = whole.withColumn("step", F.floor(F.col("score") * 100))
    steps = whole.groupBy("step").agg(F.sum("v").alias("sv"), F.sum("r").alias("sr"), F.min("score").alias("low"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("step", F.coalesce(F.sum("sv").over(above), F.lit(0)).alias("sv"), F.coalesce(F.sum("sr").over(above), F.lit(0)).alias("sr"), F.min("low").over(Window.partitionBy()).alias("least"))
    down = Window.partitionBy("step").orderBy(F.desc("score"))
    cum = whole.select("score", "step", F.sum("v").over(down).alias("v"), F.sum("r").over(down).alias("r")).join(F.broadcast(steps), "step")
    cum = cum.select("score", "least", (F.col("v") + F.col("sv")).alias("v"), (F.col("r") + F.col("sr")).alias("r"))
    rows = cum.where("score > least and r > 0").select(F.col("score").alias("threshold"), F.col("v").cast("double").alias("v"), F.col("r").cast("double").alias("r"))
    spark = scores.sparkSession
    rows = rows.unionByName(spark.range(1).select(F.lit(-1.0).alias("threshold"), F.lit(1.0).alias("v"), F.lit(1.0).alias("r")))
    rows = rows.withColumn("fdr", F.least(F.lit(1.0), F.col("v") / F.col("r"))).withColumn("rank", -F.col("threshold"))
    hundredth = F.when(F.col("threshold") < 0, F.ceil(F.col("threshold") * 100)).otherwise(F.floor(F.col("threshold") * 100))
    order, columns = ["rank"], ["threshold", "v", "r", "fdr", "rank"]
    for key, alike in (("fdr", F.floor(F.col("fdr") * 1e6)), ("v", F.floor("v")), ("r", F.floor("r")), ("threshold", hundredth)):
        order = [key, *order]
        if key == "threshold":
            rows = rows.withColumn("threshold", F.round("threshold", 2))
        last = F.max_by(F.struct(*columns), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order))))
        rows = rows.groupBy(alike.alias("alike")).agg(last.alias("row")).select("row.*")
    return rows.select("threshold", "fdr", F.col("v").alias("shuffled_bp"), F.col("r").alias("real_bp"))


#: Scores are 0 to 100, so a table by hundredths has so many steps, the sentinel's at -1 the first.
LEAST_STEP, MOST_STEP = -100, 10_000


def lookup_fdr(scores: DataFrame, table: DataFrame, score: str = "score") -> DataFrame:
    """``scores`` with the fdr of the highest threshold at or below; of the lowest if there is none, 1 without a table.

    Thresholds are hundredths. The table is spread to all hundredths - a fixed number of rows, broadcast - and joined by
    equality; as score * 100 may be rounded over a step's edge, a step knows its neighbours' values and its edges.
    """
    steps = scores.sparkSession.range(LEAST_STEP, MOST_STEP + 1).select(F.col("id").alias("step"))
    known = table.select(F.round(F.col("threshold") * 100).cast("bigint").alias("step"), "fdr")
    along = Window.orderBy("step")
    dense = steps.join(known, "step", "left").select("step", F.coalesce(F.last("fdr", ignorenulls=True).over(along), F.first("fdr", ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0)).alias("f"))
    dense = dense.select(F.col("step").alias("_step"), F.lag("f", 1).over(along).alias("_before"), F.col("f").alias("_f"), F.lead("f", 1).over(along).alias("_after"))
    step = F.greatest(F.lit(LEAST_STEP), F.least(F.lit(MOST_STEP), F.floor(F.col(score) * 100)))
    found = scores.withColumn("_at", step).join(F.broadcast(dense), F.col("_at") == F.col("_step"), "left")
    edge = lambda k: (F.col("_at") + k) / 100.0
    value = F.when(F.col(score) < edge(0), F.coalesce("_before", "_f")).when(F.col(score) >= edge(1), F.coalesce("_after", "_f")).otherwise(F.col("_f"))
    return found.withColumn("fdr", F.coalesce(value, F.lit(1.0))).drop("_at", "_step", "_before", "_f", "_after")


def islands(bases: DataFrame) -> DataFrame:
    """Maximal stretches of bases whose score is the rolling maximum, with the middle base's values."""
    top = bases.where((F.col("score") >= 0) & (F.abs(F.col("score") - F.col("rolling_max")) < 1e-6))
    by = Window.partitionBy("chrom").orderBy("pos")
    grouped = top.withColumn("island", F.col("pos") - F.row_number().over(by))
    mid = F.row_number().over(Window.partitionBy("chrom", "island").orderBy("pos")) - 1
    size = F.count("*").over(Window.partitionBy("chrom", "island"))
    marked = grouped.withColumn("i", mid).withColumn("n", size)
    return marked.groupBy("chrom", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), *(F.max(F.when(F.col("i") == F.expr("n div 2"), F.col(c))).alias(c) for c in ("pos", "score", "coverage", "fire_coverage"))).drop("island")


def significant(peaks: DataFrame, max_fdr: float = 0.05, min_fire_frac: float | None = None, frac_filter: float = 0.1) -> DataFrame:
    frac = F.col("fire_coverage") / F.col("coverage")
    return peaks.where(frac >= min_fire_frac) if min_fire_frac is not None else peaks.where((F.col("fdr") <= max_fdr) & (frac >= frac_filter))


def bounds(peaks: DataFrame, elements: DataFrame) -> DataFrame:
    """Peak start and end as upper medians of the elements over the island, each weighted by the bases it covers."""
    e = elements.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("element"))
    from spanforge.operators.intervals import overlap_join

    pairs = overlap_join(peaks.select("chrom", "start", "end", "pos"), e).withColumn("w", F.least("end", "b_end") - F.greatest("start", "b_start"))
    key = ["chrom", "pos"]
    out = None
    for value, name in (("b_start", "peak_start"), ("b_end", "peak_end")):
        counts = pairs.groupBy(*key, value).agg(F.sum("w").alias("w"))
        cum = counts.withColumn("c", F.sum("w").over(Window.partitionBy(*key).orderBy(value))).withColumn("t", F.sum("w").over(Window.partitionBy(*key)))
        one = cum.where(F.col("c") > F.expr("t div 2")).groupBy(*key).agg(F.min(value).alias(name))
        out = one if out is None else out.join(one, key)
    return peaks.join(out, key, "left").withColumn("peak_start", F.coalesce("peak_start", "start")).withColumn("peak_end", F.coalesce("peak_end", "end"))


def merge_once(peaks: list[dict], shared: float | None, reciprocal: float | None) -> list[dict]:
    """One pass: a peak joins the open group if it matches any member; the best by score (the last of equals) stands for it."""

    def matches(a: dict, b: dict) -> bool:
        if shared is not None and a["elements"] and b["elements"]:
            return len(a["elements"] & b["elements"]) / min(len(a["elements"]), len(b["elements"])) >= shared
        both = min(a["end"], b["end"]) - max(a["start"], b["start"])
        return reciprocal is not None and both > 0 and min(both / (a["end"] - a["start"]), both / (b["end"] - b["start"])) >= reciprocal

    groups: list[list[dict]] = []
    for p in peaks:
        if groups and any(matches(p, q) for q in groups[-1]):
            groups[-1].append(p)
        else:
            groups.append([p])
    out = []
    for g in groups:
        if len(g) == 1:
            out += g
            continue
        best = max(enumerate(g), key=lambda x: (x[1]["score"], x[0]))[1]
        starts, ends = (sorted(x for _, x in {(i, s[k]) for p in g for i, s in p["spans"].items()}) for k in (0, 1))
        merged = dict(best)
        if starts:
            merged |= {"start": starts[len(starts) // 2], "end": ends[len(ends) // 2]}
        out.append(merged)
    return out


def merge_peaks(peaks: DataFrame, reciprocal: float = 0.75, high: float = 0.9, shared: float = 0.5, passes: int = 10) -> DataFrame:
    """chrom, start, end, pos, score, fdr of merged peaks; ``peaks`` also has elements: array<struct<id, start, end>> at pos.

    The walk is in order of position and a group is only ever the latest one, so it runs in Python by chromosome, over
    peaks alone: some thousands a chromosome, whatever the coverage.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r, spans={e["id"]: (e["start"], e["end"]) for e in r["elements"]}) for r in df.sort_values(["pos"]).to_dict("records")]
        for r in rows:
            r["elements"] = set(r["spans"])
        for s, c in ((None, high), (shared, None), (None, reciprocal)):
            for _ in range(passes):
                n = len(rows)
                rows = merge_once(rows, s, c)
                if len(rows) == n:
                    break
        return pd.DataFrame([{k: r[k] for k in ("chrom", "start", "end", "pos", "score", "fdr")} for r in rows], columns=["chrom", "start", "end", "pos", "score", "fdr"])

    return peaks.groupBy("chrom").applyInPandas(run, "chrom string, start bigint, end bigint, pos bigint, score double, fdr double")


TRACKS = ("coverage", "fire_coverage", "score", "nuc", "msp")


def peak_table(peaks: DataFrame, runs: DataFrame, limits: DataFrame) -> DataFrame:
    """The 21 columns of a peak: place, FDR, five tracks at its maximum of all fibers and of either haplotype, pass_coverage.

    ``peaks``: chrom, start, end, pos, fdr; ``runs``: a pileup with nucleosomes and patches, tracks of a haplotype ending
    in _h1 and _h2 (0, 0, -1, 0, 0 where it has none); ``limits``: chrom, least, most of an accepted coverage. A peak
    outside all runs has no coverage, and a chromosome without limits passes none.
    """
    from spanforge.operators.intervals import overlap_join

    at = peaks.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    known = [f"{t}{h}" for h in ("", "_h1", "_h2") for t in TRACKS if f"{t}{h}" in runs.columns]
    there = overlap_join(at, runs.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), *known))
    there = there.select(F.col("chrom").alias("c"), F.col("start").alias("p"), *known)
    rows = peaks.select("chrom", "start", "end", "pos", "fdr").join(there, (F.col("chrom") == F.col("c")) & (F.col("pos") == F.col("p")), "left")
    rows = rows.join(limits.select(F.col("chrom").alias("l"), "least", "most"), F.col("chrom") == F.col("l"), "left")
    value = lambda t, h: F.coalesce(F.col(f"{t}{h}") if f"{t}{h}" in known else F.lit(None), F.lit(-1.0 if t == "score" else 0))
    tracks = [value(t, h).alias(f"{t}{'_coverage' if t in ('nuc', 'msp') else ''}{h.upper()}") for h in ("", "_h1", "_h2") for t in TRACKS]
    passes = F.coalesce(F.col("coverage").between(F.col("least"), F.col("most")), F.lit(False))
    return rows.select("chrom", F.col("start").alias("peak_start"), F.col("end").alias("peak_end"), F.col("pos").alias("peak_max"), F.col("fdr").alias("FDR"), *tracks, passes.alias("pass_coverage"))


def as_text(table: DataFrame) -> DataFrame:
    """A ``peak_table`` as its file has it: FDR with 10 decimals, scores with 5, true or false."""
    digits = {"FDR": "%.10f", "score": "%.5f", "score_H1": "%.5f", "score_H2": "%.5f"}
    return table.select(*(F.format_string(digits[c], c).alias(c) if c in digits else F.col(c).cast("string").alias(c) for c in table.columns))
