"""QC histograms, autocorrelation, validation, molecule features and scores."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histograms(fibers: DataFrame, annotations: DataFrame) -> DataFrame:
    """(statistic, value, count) of lengths and counts, as text values; additive over parts of the data."""
    per = annotations.groupBy("fiber_id").agg(*(F.count_if(F.col("type") == k).alias(k) for k in ("msp", "nuc", "m6a")))
    full = fibers.join(per, "fiber_id", "left").fillna(0, ["msp", "nuc", "m6a"])
    names = F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(c).cast("string").alias("value")) for n, c in (("fiber_length", "read_length"), ("msp_count", "msp"), ("nuc_count", "nuc"), ("m6a_count", "m6a"))))
    counts = full.select(F.explode(names).alias("x")).select("x.*")
    lengths = annotations.where(F.col("type").isin("msp", "nuc")).select(F.concat("type", F.lit("_length")).alias("statistic"), F.col("length").cast("string").alias("value"))
    return counts.unionByName(lengths).groupBy("statistic", "value").agg(F.count("*").alias("count"))


def phasing(fibers: DataFrame) -> DataFrame:
    return fibers.groupBy("hp").agg(F.count("*").alias("phased_reads"), F.sum("read_length").alias("phased_bp"))


def ratios(fibers: DataFrame, annotations: DataFrame) -> DataFrame:
    """Read length per nucleosome, 4 decimals: a histogram; reads without nucleosomes are null."""
    n = annotations.where("type = 'nuc'").groupBy("fiber_id").agg(F.count("*").alias("n"))
    return fibers.join(n, "fiber_id", "left").select(F.round(F.try_divide(F.col("read_length"), F.coalesce("n", F.lit(0))), 4).alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def m6a_per_msp(annotations: DataFrame) -> DataFrame:
    """(m6a_count, msp_size, is_fire, count); m6a inside an msp of its fiber."""
    keys = ["fiber_id", "q_start", "q_end", "qual"]
    msp = annotations.where("type = 'msp'").groupBy(*keys).agg(F.count("*").alias("times"))
    m6a = annotations.where("type = 'm6a'").select("fiber_id", F.col("q_start").alias("p"))
    inside = msp.join(m6a, "fiber_id", "left").groupBy(*keys, "times").agg(F.count_if((F.col("p") >= F.col("q_start")) & (F.col("p") < F.col("q_end"))).alias("m6a_count"))
    return inside.groupBy("m6a_count", (F.col("q_end") - F.col("q_start")).alias("msp_size"), (F.col("qual") >= 230).alias("is_fire")).agg(F.sum("times").alias("count"))


#: Ids of a group whose lengths are summed first.
GROUP = 4096


def autocorrelation(marks: DataFrame, fibers: DataFrame, max_lag: int = 250) -> DataFrame:
    """(lag, acf) of the 0/1 vectors of all fibers, one after another by fiber_id; biased, by lag 0.

    ``marks``: fiber_id, pos (distinct); ``fibers``: fiber_id, read_length. With x sparse, sums over products are counts of
    mark pairs at a lag, and the mean's terms are counts of marks near either end.
    """
    # running sums in two levels: along groups of ids, a row a group, and inside each
    grouped = fibers.select("fiber_id", "read_length", F.expr(f"fiber_id div {GROUP}").alias("g"))
    groups = grouped.groupBy("g").agg(F.sum("read_length").alias("n")).select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))
    own = F.sum("read_length").over(Window.partitionBy("g").orderBy("fiber_id")) - F.col("read_length")
    offsets = grouped.select("fiber_id", "g", own.alias("own")).join(groups, "g").select("fiber_id", (F.col("own") + F.col("before")).alias("off"))
    at = marks.join(offsets, "fiber_id").select((F.col("off") + F.col("pos")).alias("p"))
    size = fibers.agg(F.sum("read_length").alias("n"))
    tile = max_lag + 1
    a = at.select("p", F.explode(F.array(F.expr(f"p div {tile}"), F.expr(f"p div {tile} + 1"))).alias("t"))
    b = at.select(F.col("p").alias("q"), F.expr(f"p div {tile}").alias("t"))
    pairs = a.join(b, "t").where(f"q >= p and q - p <= {max_lag}").groupBy((F.col("q") - F.col("p")).alias("lag")).agg(F.count("*").alias("xx"))
    lags = marks.sparkSession.range(max_lag + 1).select(F.col("id").alias("lag"))
    total = at.agg(F.count("*").alias("k"))
    edge = at.crossJoin(F.broadcast(size)).select(F.least(F.col("p"), F.lit(max_lag + 1)).alias("from_low"), F.least(F.col("n") - 1 - F.col("p"), F.lit(max_lag + 1)).alias("from_high"))
    low, high = edge.groupBy("from_low").agg(F.count("*").alias("c")), edge.groupBy("from_high").agg(F.count("*").alias("c"))
    first = lags.join(F.broadcast(low), F.col("from_low") < F.col("lag"), "left").groupBy("lag").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("first"))
    last = lags.join(F.broadcast(high), F.col("from_high") < F.col("lag"), "left").groupBy("lag").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("last"))
    rows = lags.join(pairs, "lag", "left").join(first, "lag").join(last, "lag").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total))
    m = F.col("k") / F.col("n")
    cov = F.coalesce("xx", F.lit(0)) - m * (F.col("k") * 2 - F.col("first") - F.col("last")) + m * m * (F.col("n") - F.col("lag"))
    zero = F.col("k") - m * F.col("k")
    return rows.select("lag", F.round(cov / zero, 9).alias("acf"))


def acf(x: list[float], max_lag: int) -> list[float]:
    """Biased autocorrelation of one vector."""
    v = np.asarray(x, float) - np.mean(x)
    return [float(v[: len(v) - k] @ v[k:] / (v @ v)) for k in range(max_lag + 1)]


def validate(fibers: DataFrame, annotations: DataFrame, reads: int = 5000) -> DataFrame:
    """Fractions with m6a, with nucleosomes, phased, of the first ``reads`` fibers by id."""
    first = fibers.orderBy("fiber_id").limit(reads)
    has = annotations.groupBy("fiber_id").agg(F.bool_or(F.col("type") == "m6a").alias("m6a"), F.bool_or(F.col("type") == "nuc").alias("nuc"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return first.join(has, "fiber_id", "left").agg(F.count("*").alias("reads"), share(F.col("m6a")).alias("frac_m6a"), share(F.col("nuc")).alias("frac_nuc"), share(F.col("hp") != "UNK").alias("frac_phased"))


def balance(df: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has, by hash order; ranks inside hash buckets keep no label in one task."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    least = sizes.agg(F.min("n").alias("least"))
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns), F.lit(str(seed))))
    bucketed = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    counts = bucketed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = bucketed.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h"))).join(before, [label, "_b"]).crossJoin(F.broadcast(least))
    return ranked.where(F.col("_before") + F.col("_r") <= F.col("least")).select(df.columns)


def feature_names(bins: int = 9) -> list[str]:
    regions = ["msp", "best", "worst", *(f"bin_{i}" for i in range(bins))]
    return ["msp_len", "read_length", "fiber_m6a_count", "fiber_at_count", "fiber_frac_m6a", *(f"{r}_{k}" for r in regions for k in ("m6a_count", "frac_m6a", "m6a_fc"))]


def bins_around(middle: int, count: int, width: int, end: int) -> list[tuple[int, int]]:
    """``count`` windows of ``width`` around ``middle``, clipped to [0, end)."""
    low = middle - width * count // 2
    return [(min(max(low + i * width, 0), end), min(max(low + (i + 1) * width, 0), end)) for i in range(count)]


def features(molecules: DataFrame, bins: int = 9, width: int = 40, window: int = 100, least: int = 85) -> DataFrame:
    """A row an msp of at least ``least`` bases, 41 features: counts, fractions and log2 enrichment of m6a.

    ``molecules``: fiber_id, seq, marks (sorted), msps (array of struct start, length), in the query frame.
    """
    names = feature_names(bins)
    schema = f"fiber_id bigint, msp_start bigint, {', '.join(f'{n} double' for n in names)}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for fiber, seq, marks, msps in zip(df.fiber_id, df.seq, df.marks, df.msps):
                n = len(seq)
                at = np.concatenate([[0], np.cumsum(np.isin(np.frombuffer(seq.encode("ascii", "replace"), np.uint8), [65, 84, 97, 116]))])
                here = np.zeros(n, np.int64)
                here[[m for m in marks if 0 <= m < n]] = 1
                m6a = np.concatenate([[0], np.cumsum(here)])
                frac = m6a[-1] / at[-1] if at[-1] else 0.0

                def region(s: int, e: int) -> list[float]:
                    s, e = min(max(s, 0), n), min(max(e, 0), n)
                    k, t = m6a[e] - m6a[s], at[e] - at[s]
                    expected = frac * t
                    return [float(k), k / t if t else 0.0, float(np.log2(k / expected)) if k > 0 and expected > 0 else 0.0]

                for span in msps:
                    s, length = span["start"], span["length"]
                    if length < least:
                        continue
                    e = s + length
                    middle, best, worst = (s + e) // 2, [0.0] * 3, [0.0] * 3
                    if length >= 2 * window and e <= n:
                        starts = np.arange(s, e - window + 1)
                        k = m6a[starts + window] - m6a[starts]
                        i, j = int(k.argmax()), int(k.argmin())
                        best, worst = region(starts[i], starts[i] + window), region(starts[j], starts[j] + window)
                        middle = int(starts[i]) + window // 2
                    row = [float(length), float(n), float(m6a[-1]), float(at[-1]), frac, *region(s, e), *best, *worst]
                    for a, b in bins_around(middle, bins, width, n):
                        row += region(a, b)
                    out.append([fiber, s, *row])
            yield pd.DataFrame(out, columns=["fiber_id", "msp_start", *names])

    return molecules.select("fiber_id", "seq", "marks", "msps").mapInPandas(run, schema)


def load_trees(path: str) -> tuple[float, list[dict]]:
    """Base score, on the first line, and the trees of a JSON dump."""
    with open(path) as f:
        first, rest = f.readline(), f.read()
    return float(first), json.loads(rest)


def tree_scores(rows: DataFrame, names: list[str], trees: list[dict], base: float = 0.5) -> DataFrame:
    """``rows`` with ``score``: the logistic of the trees' leaves and the base's logit. Trees: split, split_condition, yes, no, missing, children or leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, score double"

    def leaf(node: dict, x: dict[str, np.ndarray], index: np.ndarray, out: np.ndarray) -> None:
        if "leaf" in node:
            out[index] += node["leaf"]
            return
        name = node["split"]
        v = x[names[int(name[1:])] if name not in x else name][index]
        to = {c["nodeid"]: c for c in node["children"]}
        low, none = v < node["split_condition"], np.isnan(v)
        yes = np.where(none, node.get("missing", node["yes"]) == node["yes"], low)
        leaf(to[node["yes"]], x, index[yes], out)
        leaf(to[node["no"]], x, index[~yes], out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x, total = {n: df[n].to_numpy(float) for n in names}, np.full(len(df), np.log(base / (1 - base)))
            for tree in shared.value:
                leaf(tree, x, np.arange(len(df)), total)
            yield df.assign(score=1 / (1 + np.exp(-total)))

    return rows.mapInPandas(run, schema)


def precision_table(path: str) -> list[tuple[float, int]]:
    """(score, precision 0 to 255) with the ends (0, 0) and (1, 255) from {"columns": [...], "data": [[score, q], ...]}."""
    with open(path) as f:
        data = json.load(f)["data"]
    known = {float(s): int(np.floor((1 - q) * 255 + 0.5)) for s, q in data}
    return sorted({0.0: 0, 1.0: 255, **known}.items())
