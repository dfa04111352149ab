"""Interval joins and interval algebra.

Joins cut both sides in tiles and join on (chrom, tile); the overlap test is the residual, and a pair belongs to the
tile of the later of the two starts, so none comes twice and no distinct is needed. Depths are sweeps over boundary
events, clipped to windows: every window is a partition of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 5000
#: A side of a join may be broadcast only after its rows were counted and are under this, in bytes.
SMALL = 16 << 20
#: Tiles of a join whose one side is broadcast: smaller ones compare fewer rows, and nothing is shuffled.
FINE = 500


def _tiled(df: DataFrame, start: str, end: str, tile: int) -> DataFrame:
    last = F.greatest(F.expr(f"({end} - 1) div {tile}"), F.expr(f"{start} div {tile}"))
    return df.withColumn("_tile", F.explode(F.sequence(F.expr(f"{start} div {tile}"), last)))


def overlap_join(a: DataFrame, b: DataFrame, tile: int = TILE, small: bool = False) -> DataFrame:
    """Inner join of overlapping rows; ``a`` has chrom, start, end, ``b`` has b_chrom, b_start, b_end (half-open). A ``small`` b is broadcast."""
    left, right = _tiled(a, "start", "end", tile), _tiled(b, "b_start", "b_end", tile).withColumnRenamed("_tile", "_b_tile")
    meets = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    owner = F.expr(f"greatest(start, b_start) div {tile}")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_tile") == F.col("_b_tile")) & meets & (F.col("_tile") == owner)
    return left.join(F.broadcast(right) if small else right, on).drop("_tile", "_b_tile")


def running_sums(events: DataFrame, values: list[str], asked: DataFrame, tile: int = TILE) -> DataFrame:
    """``asked`` (chrom, pos, order and more) with the sums of ``values`` over the events of its chrom at or before (pos, order).

    ``events``: chrom, pos, order, values. Two levels: sums along tiles, a row a tile, and inside each tile.
    """
    more = [c for c in asked.columns if c not in ("chrom", "pos", "order")]
    summed = events.groupBy("chrom", "pos", "order").agg(*(F.sum(v).alias(v) for v in values))
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in more]
    rows = summed.select("chrom", "pos", "order", *values, F.lit(False).alias("_asked"), *nothing)
    rows = rows.unionByName(asked.select("chrom", "pos", "order", *(F.lit(0).alias(v) for v in values), F.lit(True).alias("_asked"), *more))
    rows = rows.withColumn("_tile", F.floor(F.col("pos") / tile))
    tiles = summed.withColumn("_tile", F.floor(F.col("pos") / tile)).groupBy("chrom", "_tile").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    there = asked.select("chrom", F.floor(F.col("pos") / tile).alias("_tile")).distinct()
    tiles = tiles.join(there, ["chrom", "_tile"], "full")
    before = Window.partitionBy("chrom").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select("chrom", "_tile", *(F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values))
    within = Window.partitionBy("chrom", "_tile").orderBy("pos", "order")
    found = rows.select("chrom", "pos", "order", "_tile", "_asked", *more, *(F.sum(v).over(within).alias(v) for v in values)).where("_asked")
    return found.join(tiles, ["chrom", "_tile"]).select("chrom", "pos", "order", *more, *((F.col(v) + F.col(f"_{v}")).alias(v) for v in values))


def overlap_sums(a: DataFrame, b: DataFrame, key: list[str], tile: int = TILE) -> DataFrame:
    """``key``, n and bp of each row of ``a`` that overlaps rows of ``b``: how many, and the bases of all overlaps together.

    No pair is made: what overlaps [s, e) has begun before e, less what has ended by s; likewise the bases, from sums of
    starts and ends. So a region under any number of fibers costs what any other one does.
    """
    b = b.where("b_end > b_start")
    side = lambda pos, order, first, last: F.struct(F.col(pos).alias("pos"), F.lit(order).alias("order"), F.lit(first).alias("begun"), F.lit(last).alias("ended"), (F.col(pos) * first).alias("starts"), (F.col(pos) * last).alias("ends"))
    events = b.select(F.col("b_chrom").alias("chrom"), F.explode(F.array(side("b_start", 2, 1, 0), side("b_end", 0, 0, 1))).alias("e")).select("chrom", "e.*")
    # at one position: ends, then what is asked, then starts
    ask = lambda pos, is_end: F.struct(F.col(pos).alias("pos"), F.lit(1).alias("order"), F.lit(is_end).alias("is_end"))
    asked = a.where("end > start").select("chrom", *key, F.explode(F.array(ask("start", False), ask("end", True))).alias("e")).select("chrom", "e.*", *key)
    sums = running_sums(events, ["begun", "ended", "starts", "ends"], asked, tile)
    covered = F.col("pos") * (F.col("begun") - F.col("ended")) - F.col("starts") + F.col("ends")
    at = sums.select(*key, "is_end", "begun", "ended", covered.alias("bp"))
    pick = lambda c, is_end: F.max(F.when(F.col("is_end") == is_end, F.col(c)))
    return at.groupBy(*key).agg((pick("begun", True) - pick("ended", False)).alias("n"), (pick("bp", True) - pick("bp", False)).alias("bp")).where("n > 0")


def overlap_semi(a: DataFrame, b: DataFrame, key: list[str], fraction: float = 0.0, tile: int = TILE, anti: bool = False) -> DataFrame:
    """Rows of ``a`` that overlap some row of ``b`` (by ``fraction`` of their length), or none; ``key`` names a row."""
    if fraction:
        met = overlap_join(a, b, tile).where((F.least("end", "b_end") - F.greatest("start", "b_start")) >= F.lit(fraction) * (F.col("end") - F.col("start"))).select(*key).distinct()
    else:
        met = overlap_sums(a, b, key, tile).select(*key)
    return a.join(met, key, "left_anti" if anti else "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over four tasks a core, however few files or row groups it was read from."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def point_join(a: DataFrame, points: DataFrame, tile: int = TILE) -> DataFrame:
    """``a`` (chrom, start, end) with the points (p_chrom, pos) inside it.

    Few points are broadcast, after they were counted; then ``a`` and what it carries aren't shuffled. The pairs never are.
    """
    ends = points.withColumn("b_chrom", F.col("p_chrom")).withColumn("b_start", F.col("pos")).withColumn("b_end", F.col("pos") + 1)
    return spread_join(a, ends, points.count() * 128, tile).drop("b_chrom", "b_start", "b_end")


def spread_join(a: DataFrame, b: DataFrame, size: int, tile: int = TILE) -> DataFrame:
    """``overlap_join``; ``b`` is broadcast in fine tiles if its counted ``size`` (bytes) is small. The rows are the same."""
    return overlap_join(a, b, FINE, small=True) if size <= SMALL else overlap_join(a, b, tile)


def overlap_self_semi(r: DataFrame, fraction: float, tile: int = TILE) -> DataFrame:
    """Rows of ``r`` (chrom, start, end) that another row overlaps by ``fraction`` (up to 1) of their length.

    No pair of rows is made. Of the rows that begin before a row, at its start, or at one place inside it, the one that
    ends last overlaps it most: a running maximum, the two last ends of each start, and, for rows that these leave open,
    the last end of each start inside.
    """
    each = r.where("end > start").groupBy("chrom", "start", "end").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("chrom", "start").orderBy(F.desc("end")))
    two = each.withColumn("place", place).where("place <= 2")
    starts = two.groupBy("chrom", "start").agg(F.max("end").alias("last"), F.max(F.when(F.col("place") == 2, F.col("end"))).alias("next")).withColumn("_tile", F.floor(F.col("start") / tile))
    tiles = starts.groupBy("chrom", "_tile").agg(F.max("last").alias("most"))
    tiles = tiles.withColumn("most", F.max("most").over(Window.partitionBy("chrom").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.max("last").over(Window.partitionBy("chrom", "_tile").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("before", within).join(tiles, ["chrom", "_tile"]).withColumn("before", F.greatest("before", "most"))
    least = F.lit(fraction) * (F.col("end") - F.col("start"))
    beside = F.when(F.col("end") == F.col("last"), F.col("next")).otherwise(F.col("last"))
    reach = F.greatest("before", beside)
    met = (F.col("times") > 1) | (reach.isNotNull() & (F.least(F.col("end"), reach) - F.col("start") >= least))
    told = each.join(starts, ["chrom", "start"]).select("chrom", "start", "end", met.alias("met"))
    inside = starts.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), (F.col("start") + 1).alias("b_end"), "last")
    rest = overlap_join(told.where("not met").select("chrom", "start", "end"), inside, tile).where((F.col("b_start") > F.col("start")) & (F.least("end", "last") - F.col("b_start") >= least))
    found = told.where("met").select("chrom", "start", "end").unionByName(rest.select("chrom", "start", "end"))
    return r.join(found.distinct(), ["chrom", "start", "end"], "left_semi")


def depth_runs(intervals: DataFrame, values: list[str], window: int) -> DataFrame:
    """chrom, win, start, end and the sums of ``values`` over the intervals that cover each run.

    Boundary events are summed by position before the window function runs, and windows are clipped, so a task never
    holds more than the distinct boundaries of one window.
    """
    cut = _tiled(intervals, "start", "end", window).withColumnRenamed("_tile", "win")
    low, high = F.greatest(F.col("start"), F.col("win") * window), F.least(F.col("end"), (F.col("win") + 1) * window)
    sides = F.array(F.struct(low.alias("pos"), F.lit(1).alias("sign")), F.struct(high.alias("pos"), F.lit(-1).alias("sign")))
    events = cut.select("chrom", "win", F.explode(sides).alias("e"), *values).groupBy("chrom", "win", F.col("e.pos").alias("pos")).agg(*(F.sum(F.col(v) * F.col("e.sign")).alias(v) for v in values))
    by = Window.partitionBy("chrom", "win").orderBy("pos")
    runs = events.select("chrom", "win", F.col("pos").alias("start"), F.lead("pos").over(by).alias("end"), *(F.sum(v).over(by).alias(v) for v in values))
    return runs.where("end is not null")


def rle(runs: DataFrame, same: list[str], first: list[str] = []) -> DataFrame:  # noqa: B006
    """Adjacent runs of a window with equal ``same`` become one; ``first`` columns are taken at its start."""
    by = Window.partitionBy("chrom", "win").orderBy("start")
    new = ~F.coalesce((F.lag("end").over(by) == F.col("start")) & F.struct(*(F.lag(c).over(by).alias(c) for c in same)).eqNullSafe(F.struct(*same)), F.lit(False))
    marked = runs.withColumn("_new", new.cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(by))
    return island.groupBy("chrom", "win", "_island", *same).agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.min_by(c, "start").alias(c) for c in first)).drop("_island")


def _covered(df: DataFrame, name: str) -> DataFrame:
    return df.select("chrom", "start", "end", F.lit(1).alias(name))


def _islands(runs: DataFrame, distance: int = 0) -> DataFrame:
    """Runs of one chrom no more than ``distance`` apart as one; on runs already merged inside windows."""
    by = Window.partitionBy("chrom").orderBy("start")
    new = (F.col("start") > F.lag("end").over(by) + distance) | F.lag("end").over(by).isNull()
    return runs.withColumn("_i", F.sum(new.cast("int")).over(by)).groupBy("chrom", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def merge(df: DataFrame, distance: int = 0, window: int = 1_000_000) -> DataFrame:
    """Union of intervals; gaps of up to ``distance`` are closed."""
    runs = depth_runs(_covered(df, "n"), ["n"], window).where("n > 0").withColumn("n", F.lit(1))
    return _islands(rle(runs, ["n"]), distance)


def subtract(a: DataFrame, b: DataFrame, window: int = 1_000_000) -> DataFrame:
    """Maximal stretches covered by ``a`` and not by ``b``."""
    both = a.select("chrom", "start", "end", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("chrom", "start", "end", F.lit(0).alias("x"), F.lit(1).alias("y")))
    runs = depth_runs(both, ["x", "y"], window).where("x > 0 and y = 0").withColumn("x", F.lit(1)).drop("y")
    return _islands(rle(runs, ["x"]))


def complement(df: DataFrame, contigs: DataFrame, window: int = 1_000_000) -> DataFrame:
    """What ``df`` leaves of the contigs (chrom, length)."""
    return subtract(contigs.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end")), df, window)


def shuffle(df: DataFrame, contigs: DataFrame, key: Column, seed: int = 42, replicas: int = 1) -> DataFrame:
    """Each interval at a uniform place of its contig, its length kept; a function of (key, seed, replica) alone."""
    many = df.join(contigs, "chrom").withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas)))) if replicas > 1 else df.join(contigs, "chrom").withColumn("replica", F.lit(1))
    room = F.greatest(F.col("length") - (F.col("end") - F.col("start")) + 1, F.lit(1))
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.col("replica").cast("string")))
    placed = many.withColumn("_s", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % room)
    return placed.withColumn("end", F.col("_s") + F.col("end") - F.col("start")).withColumn("start", F.col("_s")).drop("_s", "length")


def split_windows(contigs: DataFrame, size: int) -> DataFrame:
    """Fixed windows of each contig (chrom, length); the last is cut."""
    at = contigs.where("length > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))))
    return at.select("chrom", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))


def weighted_median(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Median of ``value``, each counted ``weight`` times; the mean of the middle two for an even total."""
    counts = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy(value)
    cum = counts.withColumn("_c", F.sum("_w").over(w)).withColumn("_t", F.sum("_w").over(Window.partitionBy(*by)))
    low, high = F.min(F.when(F.col("_c") * 2 >= F.col("_t"), F.col(value))), F.min(F.when(F.col("_c") * 2 > F.col("_t"), F.col(value)))
    return cum.groupBy(*by).agg(((low + high) / 2.0).alias("median"))


def nearest(scores: DataFrame, table: DataFrame, tile: int = 4096) -> DataFrame:
    """``scores`` (s) with the value of the nearest key of ``table`` (key, value); ties go to the lower key.

    The last key at or below and the first at or above, in two levels: inside a tile of ``tile`` keys, and along tiles, a
    row a tile.
    """
    keys = table.select(F.col("key").alias("s"), F.struct("key", "value").alias("k"))
    asked = scores.select("s").distinct().select("s", F.lit(None).cast(keys.schema["k"].dataType).alias("k"))
    both = asked.unionByName(keys).withColumn("_tile", F.floor(F.col("s") / tile))
    # aggregated before the windows, which then see a row a tile
    tiles = both.groupBy("_tile").agg(F.min("k").alias("least"), F.max("k").alias("most"))
    along = Window.orderBy("_tile")
    tiles = tiles.select("_tile", F.last("most", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.first("least", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    within = Window.partitionBy("_tile").orderBy("s")
    low, high = F.last("k", ignorenulls=True).over(within.rangeBetween(Window.unboundedPreceding, 0)), F.first("k", ignorenulls=True).over(within.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("lo", low).withColumn("hi", high).where("k is null").join(tiles, "_tile").select("s", F.coalesce("lo", "below").alias("lo"), F.coalesce("hi", "above").alias("hi"))
    pick = F.when(F.col("hi").isNull() | (F.col("s") - F.col("lo.key") <= F.col("hi.key") - F.col("s")), F.col("lo.value")).otherwise(F.col("hi.value"))
    return scores.join(found.select("s", F.when(F.col("lo").isNull(), F.col("hi.value")).otherwise(pick).alias("value")), "s", "left")
