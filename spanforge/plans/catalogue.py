"""Every query by name, and its SQL for DuckDB.

Names ending in an operator's variant apply it with that option. All run over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import codec, coords, scalars
from spanforge.operators import calls, filters, intervals, peaks, stats, views
from spanforge.operators.pileup import PileupOptions, pileup, rolling_max, shuffled
from spanforge.sources import tables as T
from spanforge.sources.written import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WITH = f"WITH {T.SQL}"
ANNOTATION = "fiber_id, type, fwd_start, length, qual"
#: About a region's length: few rows of a tile don't overlap.
REGION_TILE = 250
MODULES = [(0, 8), (8, 16), (16, 24), (24, 35)]


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql if sql.lstrip().startswith("WITH") else WITH + sql
        return f

    return add


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fibers(spark, sf_dir).groupBy("chrom").agg((F.max("ref_end") + 10000).alias("length"))


CONTIGS = "contigs AS (SELECT chrom, max(ref_end) + 10000 AS length FROM fibers GROUP BY chrom)"


# Scans and filters


@query("SELECT * FROM fibers")
def scan_fibers(spark, d):
    return T.fibers(spark, d)


@query(f"SELECT {ANNOTATION}, q_start, q_end, r_start, r_end FROM annotations")
def scan_annotations(spark, d):
    return T.annotations(spark, d).select(*ANNOTATION.split(", "), "q_start", "q_end", "r_start", "r_end")


@query("SELECT chrom, start, \"end\", coalesce(name, chrom || ':' || start || '-' || \"end\") AS name FROM regions")
def bed_regions(spark, d):
    from spanforge.sources.readers import region_name

    return T.regions(spark, d).select("chrom", "start", "end", region_name(F.col("name"), F.col("chrom"), F.col("start"), F.col("end")).alias("name"))


@query("SELECT fiber_id, flag FROM fibers WHERE flag & 2308 = 0")
def filter_bitflag(spark, d):
    return filters.bit_flag(T.fibers(spark, d), 2308).select("fiber_id", "flag")


@query(f"SELECT {ANNOTATION} FROM annotations WHERE type NOT IN ('m6a', 'cpg') OR qual >= 125")
def filter_min_ml(spark, d):
    return filters.min_quality(T.annotations(spark, d)).select(*ANNOTATION.split(", "))


@query(f"SELECT {ANNOTATION} FROM annotations WHERE type NOT IN ('m6a', 'cpg') OR (fwd_start >= 100 AND fwd_start < read_length - 100)")
def filter_strip_ends(spark, d):
    return filters.strip_ends(T.annotations(spark, d), 100).select(*ANNOTATION.split(", "))


@query(f"SELECT {ANNOTATION} FROM annotations WHERE type NOT IN ('nuc', 'msp') OR (fwd_start >= 45 AND fwd_start + length <= read_length - 45)")
def filter_ends(spark, d):
    return filters.away_from_ends(T.annotations(spark, d)).select(*ANNOTATION.split(", "))


@query(f"SELECT {ANNOTATION} FROM annotations WHERE type <> 'msp' OR (length >= 30 AND length < 90)")
def filter_len_range(spark, d):
    return filters.expression(T.annotations(spark, d), "len(msp)=30:90").select(*ANNOTATION.split(", "))


@query(f"SELECT {ANNOTATION} FROM annotations WHERE type <> 'msp' OR qual >= 200")
def filter_qual_ge(spark, d):
    return filters.expression(T.annotations(spark, d), "qual(msp)>=200").select(*ANNOTATION.split(", "))


@query(f"SELECT {ANNOTATION} FROM annotations WHERE (type <> 'nuc' OR length < 150) AND (type <> 'm6a' OR qual >= 125) AND (type <> 'msp' OR length <> 60)")
def expr_filter_multi(spark, d):
    return filters.expression(T.annotations(spark, d), "len(nuc)<150, qual(m6a)>=125, len(msp)!=60").select(*ANNOTATION.split(", "))


@query("SELECT f.fiber_id FROM fibers f JOIN (SELECT fiber_id FROM marks GROUP BY 1 HAVING count(*) FILTER (type = 'msp') >= 2 AND count(*) FILTER (type = 'm6a') > 0 AND sum(length) FILTER (type = 'msp') // count(*) FILTER (type = 'msp') >= 60) USING (fiber_id)")
def filter_fire_fiber(spark, d):
    return filters.fire_fibers(T.fibers(spark, d), T.marks(spark, d), True, 2, 60).select("fiber_id")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'pacbio' WHEN event_type = 'view' THEN 'ont' WHEN event_id % 2 = 0 THEN 'pacbio' ELSE 'unknown' END AS platform FROM events")
def filter_platform(spark, d):
    e = T.table(spark, d, "events")
    tags = F.when(F.col("event_type") == "click", F.create_map(F.lit("zm"), F.lit("1"))).when(F.col("event_type") == "view", F.create_map(F.lit("ch"), F.lit("1"))).otherwise(F.create_map(F.lit("NM"), F.lit("1")))
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m84081_231207_200206_s1/"), F.col("event_id").cast("string"), F.lit("/ccs"))).otherwise("read")
    return e.select("event_id", scalars.platform(tags, name).alias("platform"))


@query(f"SELECT {ANNOTATION} FROM annotations WHERE NOT (type = 'm6a' AND qual < 100)")
def strip_basemods(spark, d):
    return filters.strip_basemods(T.annotations(spark, d), min_quality=100).select(*ANNOTATION.split(", "))


# Coordinates


@query("SELECT fiber_id, q_start, q_end FROM flipped")
def flip_coords(spark, d):
    return T.annotations(spark, d).select("fiber_id", "q_start", "q_end")


LIFTED = "lifted AS (SELECT x.*, l.s, l.e FROM (SELECT row_number() OVER () AS rid, * FROM flipped) x LEFT JOIN (SELECT rid, min(r + greatest(q_start, a) - a) AS s, max(r + least(q_end, b) - a) AS e FROM (SELECT row_number() OVER () AS rid, * FROM flipped) f JOIN blocks USING (fiber_id) WHERE a < q_end AND b > q_start GROUP BY rid) l USING (rid))"


@query(f", {LIFTED} SELECT fiber_id, type, q_start, q_end, s AS r_start, e AS r_end FROM lifted")
def lift_range(spark, d):
    return T.annotations(spark, d, blocks=True).select("fiber_id", "type", "q_start", "q_end", "r_start", "r_end")


@query("SELECT f.fiber_id, f.q_start, b.r + f.q_start - b.a AS r_pos FROM flipped f LEFT JOIN blocks b ON f.fiber_id = b.fiber_id AND b.a <= f.q_start AND f.q_start < b.b")
def lift_point(spark, d):
    a = T.annotations(spark, d, blocks=True)
    return a.select("fiber_id", "q_start", coords.lift_point(F.col("blocks"), F.col("q_start")).alias("r_pos"))


@query("SELECT f.fiber_id, min(a + greatest(r, ref_start + 850) - r) AS q_start, max(a + least(r + b - a, ref_start + 1100) - r) AS q_end FROM fibers f JOIN blocks USING (fiber_id) WHERE r < ref_start + 1100 AND r + b - a > ref_start + 850 GROUP BY 1")
def lift_inverse(spark, d):
    f = T.with_blocks(T.fibers(spark, d))
    q = coords.lift_inverse(F.col("blocks"), F.col("ref_start") + 850, F.col("ref_start") + 1100)
    return f.select("fiber_id", q["start"].alias("q_start"), q["end"].alias("q_end"))


@query("SELECT fiber_id, CASE WHEN strand = '-' THEN -(q_end - 1000) + 1 ELSE q_start - 1000 END AS p_start, CASE WHEN strand = '-' THEN -(q_start - 1000) + 1 ELSE q_end - 1000 END AS p_end FROM flipped")
def project_centered(spark, d):
    s, e = coords.project(F.col("q_start"), F.col("q_end"), F.lit(1000), F.col("strand") == "-")
    return T.annotations(spark, d).select("fiber_id", s.alias("p_start"), e.alias("p_end"))


@query("SELECT f.fiber_id, coalesce(min(r_start) FILTER (type IN ('msp', 'nuc')), f.ref_start) AS start, coalesce(max(r_end) FILTER (type IN ('msp', 'nuc')), f.ref_end) AS \"end\" FROM fibers f LEFT JOIN annotations a USING (fiber_id) GROUP BY f.fiber_id, f.ref_start, f.ref_end")
def fiber_extent(spark, d):
    own = T.annotations(spark, d).where(F.col("type").isin("msp", "nuc")).groupBy("fiber_id").agg(F.min("r_start").alias("s"), F.max("r_end").alias("e"))
    return T.fibers(spark, d).join(own, "fiber_id", "left").select("fiber_id", F.coalesce("s", "ref_start").alias("start"), F.coalesce("e", "ref_end").alias("end"))


@query(f", {CONTIGS} SELECT chrom, s AS start, least(s + 1000, length) AS \"end\" FROM (SELECT chrom, length, unnest(range(0, length, 1000)) AS s FROM contigs)")
def windows_split(spark, d):
    return intervals.split_windows(contigs(spark, d), 1000)


@query("SELECT fiber_id, a::BIGINT AS q_start, b::BIGINT AS q_end, r::BIGINT AS r_start FROM blocks")
def cigar_blocks(spark, d):
    f, n, kind = T.fibers(spark, d), F.col("read_length"), F.col("fiber_id") % 3
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    cigar = F.when(kind == 0, text("1000M50D", n - 1000, "M")).when(kind == 1, text("900M40I", n - 940, "M")).otherwise(text(n, "="))
    return f.select("fiber_id", F.inline(coords.cigar_blocks(cigar, F.col("ref_start"))))


# Joins


def as_intervals(fibers: DataFrame) -> DataFrame:
    return fibers.select("fiber_id", "chrom", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))


def as_b(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), *more)


OVERLAP = 'r.chrom = f.chrom AND f.ref_start < r."end" AND r.start < f.ref_end'


@query(f"SELECT r.region_id, r.name, count(*) AS n, sum(least(f.ref_end, r.\"end\") - greatest(f.ref_start, r.start))::BIGINT AS bp FROM fibers f JOIN regions r ON {OVERLAP} GROUP BY ALL")
def join_region_overlap(spark, d):
    return intervals.overlap_sums(T.regions(spark, d), as_b(as_intervals(T.fibers(spark, d))), ["region_id", "name"])


@query(f"SELECT f.fiber_id FROM fibers f WHERE EXISTS (SELECT 1 FROM regions r WHERE {OVERLAP})")
def join_region_semi(spark, d):
    return intervals.overlap_semi(as_intervals(T.fibers(spark, d)), as_b(T.regions(spark, d)), ["fiber_id"]).select("fiber_id")


@query(f"SELECT f.fiber_id FROM fibers f WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE {OVERLAP})")
def join_region_anti(spark, d):
    return intervals.overlap_semi(as_intervals(T.fibers(spark, d)), as_b(T.regions(spark, d)), ["fiber_id"], anti=True).select("fiber_id")


@query('SELECT a.region_id FROM regions a WHERE EXISTS (SELECT 1 FROM regions b WHERE b.region_id <> a.region_id AND a.chrom = b.chrom AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.25 * (a."end" - a.start))')
def join_frac_overlap(spark, d):
    return intervals.overlap_self_semi(T.regions(spark, d), 0.25).select("region_id")


@query("SELECT fiber_id, chrom, (fiber_id * 31) % 20000 AS ref_start, (fiber_id * 31) % 20000 + read_length AS ref_end FROM fibers")
def join_shuffle_equi(spark, d):
    f = T.fibers(spark, d)
    return shuffled(f, f.select("chrom", "fiber_id", "ref_start", ((F.col("fiber_id") * 31) % 20000).alias("new_start"))).select("fiber_id", "chrom", "ref_start", "ref_end")


@query("SELECT c.center_id, f.fiber_id FROM centers c JOIN fibers f ON c.chrom = f.chrom AND f.ref_start <= c.pos AND c.pos < f.ref_end")
def join_center_point(spark, d):
    return intervals.point_join(intervals.spread(as_intervals(T.fibers(spark, d))), T.centers(spark, d).select(F.col("chrom").alias("p_chrom"), "pos", "center_id")).select("center_id", "fiber_id")


MOTIFS = "motifs AS (SELECT chrom, pos AS start, pos + 34 AS \"end\", strand, center_id AS motif_id FROM centers)"


def motif_rows(spark, d):
    return T.centers(spark, d).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 34).alias("end"), "strand", F.col("center_id").alias("motif_id"))


@query(f", {MOTIFS} SELECT m.motif_id, f.fiber_id FROM motifs m JOIN fibers f ON m.chrom = f.chrom AND m.start > f.ref_start AND m.\"end\" < f.ref_end")
def join_motif_span(spark, d):
    motifs = motif_rows(spark, d)
    pairs = intervals.spread_join(intervals.spread(as_intervals(T.fibers(spark, d))), as_b(motifs, "motif_id"), motifs.count() * 128)
    return pairs.where("b_start > start and b_end < end").select("motif_id", "fiber_id")


@query("SELECT chrom, CASE WHEN chrom IN ('chr1', 'chr2') THEN 1 WHEN chrom IN ('chr3') THEN 2 END AS hap, count(*) AS n FROM fibers GROUP BY ALL")
def join_contig_hap(spark, d):
    haps = spark.createDataFrame([("chr1", 1), ("chr2", 1), ("chr3", 2)], "chrom string, hap int")
    return T.fibers(spark, d).join(F.broadcast(haps), "chrom", "left").groupBy("chrom", "hap").agg(F.count("*").alias("n"))


@query("SELECT m6a_count, msp_size, is_fire, sum(times)::BIGINT AS count FROM (SELECT s.*, (SELECT count(*) FROM annotations m WHERE m.fiber_id = s.fiber_id AND m.type = 'm6a' AND m.q_start >= s.q_start AND m.q_start < s.q_end) AS m6a_count, s.q_end - s.q_start AS msp_size, s.qual >= 230 AS is_fire FROM (SELECT fiber_id, q_start, q_end, qual, count(*) AS times FROM annotations WHERE type = 'msp' GROUP BY ALL) s) GROUP BY 1, 2, 3")
def m6a_per_msp(spark, d):
    return stats.m6a_per_msp(T.annotations(spark, d))


# Pileups

WEIGHT = "round(least(100.0, log10(1.0::DOUBLE - least(qual, 253) / 255.0::DOUBLE) * -50.0::DOUBLE) * 1000000)::BIGINT"


def pileup_sql(options: PileupOptions, where: str = "TRUE", fibers: str = "fibers", annotations: str = "annotations") -> str:
    haps = (("", "TRUE"), ("_h1", "hp = 'H1'"), ("_h2", "hp = 'H2'")) if options.haps else (("", "TRUE"),)
    names = ["coverage", "fire_coverage", "raw", "nuc", "msp", "m6a", "cpg"]
    shown = ["coverage", "fire_coverage", *([] if options.no_nuc else ["nuc"]), *([] if options.no_msp else ["msp"]), *(["m6a"] if options.m6a else []), *(["cpg"] if options.cpg else [])]
    fire = "type = 'msp' AND qual >= 229"
    own = f"SELECT chrom, r_start AS s, greatest(r_end, r_start + 1) AS e, hp, 0 AS coverage, ({fire})::BIGINT AS fire_coverage, CASE WHEN {fire} THEN {WEIGHT} ELSE 0 END AS raw, (type = 'nuc')::BIGINT AS nuc, (type = 'msp')::BIGINT AS msp, (type = 'm6a' AND qual >= 125)::BIGINT AS m6a, (type = 'cpg' AND qual >= 125)::BIGINT AS cpg FROM {annotations} a"
    if options.fiber_coverage:
        extent = f", extent AS (SELECT fiber_id, min(r_start) AS s, max(r_end) AS e FROM {annotations} WHERE type IN ('msp', 'nuc') GROUP BY 1)"
        spans = f"SELECT chrom, s, e, hp, 1, 0, 0, 0, 0, 0, 0 FROM {fibers} JOIN extent USING (fiber_id)"
        own += " WHERE fiber_id IN (SELECT fiber_id FROM extent)"
    else:
        extent, spans = "", f"SELECT chrom, ref_start, ref_end, hp, 1, 0, 0, 0, 0, 0, 0 FROM {fibers}"
    zero = f", {CONTIGS}" if options.keep_zeros else ""
    parts = f"{own} UNION ALL {spans}" + (" UNION ALL SELECT chrom, 0, length, 'UNK', 0, 0, 0, 0, 0, 0, 0 FROM contigs" if options.keep_zeros else "")
    sums = ", ".join(f"sum(sum(CASE WHEN {c} THEN sign * {n} ELSE 0 END)) OVER w AS {n}{h}" for h, c in haps for n in names)
    scores = ", ".join(f"CASE WHEN fire_coverage{h} <= 0 OR fire_coverage{h} < {options.min_fire_coverage} OR coverage{h} <= 0 THEN -1.0::DOUBLE ELSE raw{h}::DOUBLE / 1000000 / coverage{h} END AS score{h}" for h, _ in haps)
    same = [f"{n}{h}" for h, _ in haps for n in shown] + [f"score{h}" for h, _ in haps]
    changed = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER v" for c in same)
    out = ", ".join(f"{n}{h}::BIGINT AS {n}{h}" for h, _ in haps for n in shown) + ", " + ", ".join(f"round(score{h}, 6) AS score{h}" for h, _ in haps)
    base = f"""{extent}{zero}, parts AS ({parts}), events AS (SELECT chrom, hp, s AS pos, 1 AS sign, {', '.join(names)} FROM parts UNION ALL SELECT chrom, hp, e, -1, {', '.join(names)} FROM parts),
    swept AS (SELECT chrom, pos AS start, lead(pos) OVER w AS stop, {sums} FROM events GROUP BY chrom, pos WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
    scored AS (SELECT *, {scores} FROM swept WHERE stop IS NOT NULL{'' if options.keep_zeros else ' AND coverage > 0'})"""
    runs = f""", flagged AS (SELECT *, CASE WHEN lag(stop) OVER v IS DISTINCT FROM start OR {changed} THEN 1 ELSE 0 END AS fresh FROM scored WINDOW v AS (PARTITION BY chrom ORDER BY start)),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start) AS island FROM flagged),
    runs AS (SELECT chrom, min(start) AS start, max(stop) AS "end", {', '.join(f'any_value({c}) AS {c}' for c in same)} FROM islands GROUP BY chrom, island)"""
    if options.per_base:
        return base + runs + f' SELECT chrom, p AS start, p + 1 AS "end", {out} FROM (SELECT *, unnest(range(start, "end")) AS p FROM runs)'
    return base + runs + f' SELECT chrom, start, "end", {out} FROM runs WHERE {where}'


def add_pileup(name: str, options: PileupOptions) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pileup(T.fibers(spark, d), T.annotations(spark, d), options, contigs(spark, d) if options.keep_zeros else None)

    query(pileup_sql(options), name)(run)


for _name, _options in {
    "pileup_default": PileupOptions(),
    "pileup_no_nuc": PileupOptions(no_nuc=True),
    "pileup_no_msp": PileupOptions(no_msp=True),
    "pileup_m6a": PileupOptions(m6a=True),
    "pileup_haps": PileupOptions(haps=True),
    "pileup_fiber_coverage": PileupOptions(fiber_coverage=True),
    "pileup_keep_zeros": PileupOptions(keep_zeros=True),
    "pileup_per_base": PileupOptions(per_base=True),
    "pileup_fire_score": PileupOptions(no_nuc=True, no_msp=True, min_fire_coverage=1),
}.items():
    add_pileup(_name, _options)


@query(pileup_sql(PileupOptions(), fibers="(SELECT * FROM fibers WHERE chrom = 'chr2' AND ref_start < 12000 AND ref_end > 8000)", annotations="(SELECT * FROM annotations WHERE chrom = 'chr2' AND ref_start < 12000 AND ref_end > 8000)"))
def pileup_region(spark, d):
    from spanforge.sources.readers import in_region

    return pileup(in_region(T.fibers(spark, d), "chr2:8,000-12,000"), in_region(T.annotations(spark, d), "chr2:8,000-12,000"))


MOVED_F = "(SELECT * REPLACE ((fiber_id * 31) % 20000 AS ref_start, (fiber_id * 31) % 20000 + read_length AS ref_end) FROM fibers)"
MOVED_A = "(SELECT * REPLACE (r_start - ref_start + (fiber_id * 31) % 20000 AS r_start, r_end - ref_start + (fiber_id * 31) % 20000 AS r_end) FROM annotations)"


def moved(spark, d):
    new = (F.col("fiber_id") * 31) % 20000
    f = T.fibers(spark, d)
    places = f.select("chrom", "fiber_id", "ref_start", new.alias("new_start"))
    a = T.annotations(spark, d).withColumn("r_start", F.col("r_start") - F.col("ref_start") + new).withColumn("r_end", F.col("r_end") - F.col("ref_start") + new)
    return shuffled(f, places), a


@query(pileup_sql(PileupOptions(no_nuc=True, no_msp=True, min_fire_coverage=1), fibers=MOVED_F, annotations=MOVED_A))
def pileup_shuffled(spark, d):
    return pileup(*moved(spark, d), PileupOptions(no_nuc=True, no_msp=True, min_fire_coverage=1))


FIRE_OPTIONS = PileupOptions(no_nuc=True, no_msp=True, min_fire_coverage=1, per_base=True)


@query(f"WITH runs AS ({WITH + pileup_sql(FIRE_OPTIONS)}) SELECT chrom, start AS pos, score, max(score) OVER (PARTITION BY chrom ORDER BY start RANGE BETWEEN 100 PRECEDING AND 99 FOLLOWING) AS rolling_max FROM runs WHERE score >= 0", "rolling_max")
def _rolling(spark, d):
    return rolling_max(pileup(T.fibers(spark, d), T.annotations(spark, d), PileupOptions(no_nuc=True, no_msp=True, min_fire_coverage=1))).select("chrom", "pos", "score", "rolling_max")


MAXIMA = f"""WITH runs AS ({WITH + pileup_sql(FIRE_OPTIONS)}), rolled AS (SELECT chrom, start AS pos, score, coverage, fire_coverage, max(score) OVER (PARTITION BY chrom ORDER BY start RANGE BETWEEN 100 PRECEDING AND 99 FOLLOWING) AS top FROM runs WHERE score >= 0),
kept AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS island FROM rolled WHERE abs(score - top) < 1e-6),
placed AS (SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chrom, island) AS n FROM kept),
maxima AS (SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", max(pos) FILTER (i = n // 2) AS pos, max(score) FILTER (i = n // 2) AS score, max(coverage) FILTER (i = n // 2) AS coverage, max(fire_coverage) FILTER (i = n // 2) AS fire_coverage FROM placed GROUP BY chrom, island)"""


def scored_islands(spark, d):
    runs = pileup(T.fibers(spark, d), T.annotations(spark, d), PileupOptions(no_nuc=True, no_msp=True, min_fire_coverage=1))
    return peaks.islands(rolling_max(runs))


@query(MAXIMA + " SELECT * FROM maxima", "local_maxima")
def _maxima(spark, d):
    return scored_islands(spark, d)


@query(f"WITH runs AS ({WITH + pileup_sql(PileupOptions(no_nuc=True, no_msp=True))}), c AS (SELECT chrom, coverage, sum(\"end\" - start) AS w FROM runs GROUP BY ALL), k AS (SELECT *, sum(w) OVER (PARTITION BY chrom ORDER BY coverage) AS cum, sum(w) OVER (PARTITION BY chrom) AS total FROM c) SELECT chrom, (min(coverage) FILTER (cum * 2 >= total) + min(coverage) FILTER (cum * 2 > total)) / 2.0::DOUBLE AS median FROM k GROUP BY chrom")
def coverage_median(spark, d):
    runs = pileup(T.fibers(spark, d), T.annotations(spark, d), PileupOptions(no_nuc=True, no_msp=True)).withColumn("w", F.col("end") - F.col("start"))
    return intervals.weighted_median(runs, "coverage", "w", ["chrom"])


# FDR and peaks

ONE = PileupOptions(no_nuc=True, no_msp=True, min_fire_coverage=1)
HISTOGRAM = f"""WITH real AS ({WITH + pileup_sql(ONE)}), fake AS ({WITH + pileup_sql(ONE, fibers=MOVED_F, annotations=MOVED_A)}),
histogram AS (SELECT score, sum("end" - start)::BIGINT AS bp, TRUE AS is_real FROM real WHERE score >= 0 GROUP BY score UNION ALL SELECT score, sum("end" - start)::BIGINT, FALSE FROM fake WHERE score >= 0 GROUP BY score)"""


def score_histogram(spark, d):
    real = pileup(T.fibers(spark, d), T.annotations(spark, d), ONE)
    return peaks.histogram(real, True).unionByName(peaks.histogram(pileup(*moved(spark, d), ONE), False))


@query(HISTOGRAM + " SELECT * FROM histogram")
def fdr_histogram(spark, d):
    return score_histogram(spark, d)


def _dedup(source: str, target: str, key: str, scale: str) -> str:
    return f"{target}_o AS (SELECT * EXCLUDE (o), row_number() OVER (ORDER BY {key}, o) AS o FROM {source}), {target} AS (SELECT * FROM {target}_o QUALIFY row_number() OVER (PARTITION BY floor({key} * {scale}) ORDER BY o DESC) = 1)"


FDR = HISTOGRAM + f""", w AS (SELECT score, coalesce(sum(bp) FILTER (is_real), 0) AS r, coalesce(sum(bp) FILTER (NOT is_real), 0) AS v FROM histogram GROUP BY score),
cum AS (SELECT score, sum(v) OVER (ORDER BY score DESC) AS v, sum(r) OVER (ORDER BY score DESC) AS r, min(score) OVER () AS least FROM w),
f0 AS (SELECT threshold, v, r, least(1.0::DOUBLE, v / r) AS fdr, row_number() OVER (ORDER BY threshold DESC) AS o FROM (SELECT score AS threshold, v::DOUBLE AS v, r::DOUBLE AS r FROM cum WHERE score > least AND r > 0 UNION ALL SELECT -1.0, 1.0, 1.0)),
{_dedup('f0', 'f1', 'fdr', '1e6::DOUBLE')}, {_dedup('f1', 'f2', 'v', '1')}, {_dedup('f2', 'f3', 'r', '1')},
f4 AS (SELECT * REPLACE (round(threshold, 2) AS threshold) FROM f3), f5 AS (SELECT * EXCLUDE (o), row_number() OVER (ORDER BY threshold, o) AS o FROM f4),
fdr AS (SELECT threshold, fdr, v AS shuffled_bp, r AS real_bp FROM f5 QUALIFY row_number() OVER (PARTITION BY trunc(threshold * 100) ORDER BY o DESC) = 1)"""


@query(FDR + " SELECT * FROM fdr", "fdr_table")
def _fdr(spark, d):
    return peaks.fdr_table(score_histogram(spark, d))


@query(FDR + " SELECT m.chrom, m.start, m.score, coalesce((SELECT max_by(f.fdr, f.threshold) FROM fdr f WHERE f.threshold <= m.score), (SELECT min_by(fdr, threshold) FROM fdr)) AS fdr FROM real m WHERE m.score >= 0")
def asof_fdr_lookup(spark, d):
    runs = pileup(T.fibers(spark, d), T.annotations(spark, d), ONE).where("score >= 0").select("chrom", "start", "score")
    return peaks.lookup_fdr(runs, peaks.fdr_table(score_histogram(spark, d)))


@query("SELECT l_orderkey % 1000 AS s, CASE WHEN (l_orderkey % 1000) <= 250 THEN 0 WHEN (l_orderkey % 1000) <= 700 THEN 200 ELSE 255 END AS value FROM lineitem")
def nearest_precision(spark, d):
    table = spark.createDataFrame([(0, 0), (500, 200), (900, 255)], "key bigint, value int")
    return intervals.nearest(T.table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("s")), table).select("s", "value")


ISLANDS = MAXIMA[MAXIMA.index("rolled AS") :].replace("FROM runs WHERE", "FROM (SELECT chrom, score, coverage, fire_coverage, unnest(range(start, \"end\")) AS start FROM real) WHERE")
RAW_PEAKS = FDR + f""", {ISLANDS},
tested AS (SELECT m.*, coalesce((SELECT max_by(f.fdr, f.threshold) FROM fdr f WHERE f.threshold <= m.score), (SELECT min_by(fdr, threshold) FROM fdr)) AS fdr FROM maxima m)"""


def raw_peaks(spark, d):
    """Written once, as are the track and the FDR table that it needs twice."""
    real = materialize(pileup(T.fibers(spark, d), T.annotations(spark, d), ONE), "pk-track")
    scores = peaks.histogram(real, True).unionByName(peaks.histogram(pileup(*moved(spark, d), ONE), False))
    table = materialize(peaks.fdr_table(scores), "pk-fdr")
    found = peaks.lookup_fdr(peaks.islands(rolling_max(real)), table)
    return materialize(peaks.significant(found, max_fdr=1.0, frac_filter=0.02), "pk-peaks")


def elements(spark, d):
    rows = T.annotations(spark, d).where("type = 'msp' and qual >= 229").select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"), "fiber_id", "qual")
    return rows.withColumn("element", F.xxhash64("chrom", "start", "end", "fiber_id", "qual"))


@query(RAW_PEAKS + " SELECT chrom, start, \"end\", pos, score, coverage, fire_coverage, fdr FROM tested WHERE fdr <= 1.0 AND fire_coverage / coverage >= 0.02")
def peaks_raw(spark, d):
    return raw_peaks(spark, d)


BOUNDED = f"WITH fires AS ({WITH} SELECT chrom, r_start, r_end FROM annotations WHERE type = 'msp' AND qual >= 229), " + RAW_PEAKS.removeprefix("WITH ") + """, peaks AS (SELECT * FROM tested WHERE fdr <= 1.0 AND fire_coverage / coverage >= 0.02),
covers AS (SELECT p.chrom, p.pos, r_start AS s, r_end AS e, least(p."end", r_end) - greatest(p.start, r_start) AS w FROM peaks p JOIN fires a ON a.chrom = p.chrom AND p.start < r_end AND r_start < p."end"),
sides AS (SELECT chrom, pos, 's' AS side, s AS x, w FROM covers UNION ALL SELECT chrom, pos, 'e', e, w FROM covers), summed AS (SELECT chrom, pos, side, x, sum(w) AS w FROM sides GROUP BY ALL),
medians AS (SELECT chrom, pos, min(x) FILTER (side = 's' AND c > t // 2) AS peak_start, min(x) FILTER (side = 'e' AND c > t // 2) AS peak_end FROM (SELECT *, sum(w) OVER (PARTITION BY chrom, pos, side ORDER BY x) AS c, sum(w) OVER (PARTITION BY chrom, pos, side) AS t FROM summed) GROUP BY chrom, pos)
SELECT chrom, start, "end", pos, score, coverage, fire_coverage, fdr, coalesce(peak_start, start) AS peak_start, coalesce(peak_end, "end") AS peak_end FROM peaks LEFT JOIN medians USING (chrom, pos)"""


@query(BOUNDED)
def peaks_bounded(spark, d):
    return peaks.bounds(raw_peaks(spark, d), elements(spark, d))


@query(None)
def peaks_merged(spark, d):
    found = materialize(peaks.bounds(raw_peaks(spark, d), elements(spark, d)), "pk-bounds")
    at = found.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("pos").alias("p"))
    e = elements(spark, d).select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "element")
    own = intervals.overlap_join(at, e).groupBy("chrom", F.col("p").alias("pos")).agg(F.collect_set(F.struct(F.col("element").alias("id"), F.col("b_start").alias("start"), F.col("b_end").alias("end"))).alias("elements"))
    full = found.join(own, ["chrom", "pos"]).select("chrom", F.col("peak_start").alias("start"), F.col("peak_end").alias("end"), "pos", "score", "fdr", "elements")
    return peaks.merge_peaks(full)


@query('SELECT a.region_id AS a, b.region_id AS b, round(least((least(a."end", b."end") - greatest(a.start, b.start)) / (a."end" - a.start), (least(a."end", b."end") - greatest(a.start, b.start)) / (b."end" - b.start)), 9) AS share FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.region_id < b.region_id AND a.start < b."end" AND b.start < a."end"')
def reciprocal_overlap(spark, d):
    r = T.regions(spark, d)
    pairs = intervals.overlap_join(r.select("chrom", "start", "end", F.col("region_id").alias("a")), as_b(r, F.col("region_id").alias("b")), REGION_TILE).where("a < b")
    share = scalars.reciprocal_overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    # rounded in floating point, not by decimals
    return pairs.select("a", "b", (F.floor(share * 1e9 + 0.5) / 1e9).alias("share"))


# QC


@query("""SELECT statistic, value, count(*) AS count FROM (
SELECT unnest(['fiber_length', 'msp_count', 'nuc_count', 'm6a_count']) AS statistic, unnest([read_length, coalesce(msp, 0), coalesce(nuc, 0), coalesce(m6a, 0)])::VARCHAR AS value FROM fibers LEFT JOIN (SELECT fiber_id, count(*) FILTER (type = 'msp') AS msp, count(*) FILTER (type = 'nuc') AS nuc, count(*) FILTER (type = 'm6a') AS m6a FROM marks GROUP BY 1) USING (fiber_id)
UNION ALL SELECT type || '_length', length::VARCHAR FROM annotations WHERE type IN ('msp', 'nuc')) GROUP BY ALL""")
def qc_histograms(spark, d):
    return stats.histograms(T.fibers(spark, d), T.annotations(spark, d))


@query("SELECT hp, count(*) AS phased_reads, sum(read_length)::BIGINT AS phased_bp FROM fibers GROUP BY hp")
def qc_phasing(spark, d):
    return stats.phasing(T.fibers(spark, d))


@query("SELECT value, count(*) AS count FROM (SELECT CASE WHEN n > 0 THEN round(read_length / n, 4) END AS value FROM fibers LEFT JOIN (SELECT fiber_id, count(*) AS n FROM marks WHERE type = 'nuc' GROUP BY 1) USING (fiber_id)) GROUP BY value")
def qc_ratios(spark, d):
    return stats.ratios(T.fibers(spark, d), T.marks(spark, d))


@query("""\
, offsets AS (SELECT fiber_id, sum(read_length) OVER (ORDER BY fiber_id) - read_length AS o FROM fibers), hits AS (SELECT DISTINCT o + fwd_start AS p FROM marks JOIN offsets USING (fiber_id) WHERE type = 'm6a'),
size AS (SELECT sum(read_length) AS n, (SELECT count(*) FROM hits) AS k FROM fibers), lags AS (SELECT unnest(range(0, 251)) AS lag),
near AS (SELECT b.p - a.p AS lag, count(*) AS xx FROM hits a JOIN hits b ON b.p >= a.p AND b.p <= a.p + 250 GROUP BY 1),
edges AS (SELECT lag, count(*) FILTER (p < lag) AS first, count(*) FILTER (p >= n - lag) AS last FROM lags, size, hits GROUP BY lag)
SELECT lag, round((coalesce(xx, 0) - m * (2 * k - first - last) + m * m * (n - lag)) / (k - m * k), 9) AS acf FROM (SELECT *, k::DOUBLE / n AS m FROM size) s, edges LEFT JOIN near USING (lag)""")
def acf_lags(spark, d):
    marks = T.marks(spark, d).where("type = 'm6a'").join(T.fibers(spark, d).select("fiber_id"), "fiber_id", "left_semi").select("fiber_id", F.col("fwd_start").alias("pos")).distinct()
    return stats.autocorrelation(marks, T.fibers(spark, d), 250)


@query("SELECT count(*) AS reads, round(avg(coalesce(m6a, FALSE)::INT), 6) AS frac_m6a, round(avg(coalesce(nuc, FALSE)::INT), 6) AS frac_nuc, round(avg((hp <> 'UNK')::INT), 6) AS frac_phased FROM (SELECT * FROM fibers ORDER BY fiber_id LIMIT 5000) LEFT JOIN (SELECT fiber_id, bool_or(type = 'm6a') AS m6a, bool_or(type = 'nuc') AS nuc FROM marks GROUP BY 1) USING (fiber_id)")
def validate_fractions(spark, d):
    return stats.validate(T.fibers(spark, d), T.marks(spark, d))


# Footprints, centers, extraction


def _codes_sql() -> str:
    place = "CASE WHEN m.strand = '-' THEN m.\"end\" - r_start - 1 ELSE r_start - m.start END"
    marks = ", ".join(f"coalesce(bool_or(type = 'm6a' AND {place} >= {a} AND {place} < {b}), FALSE) AS m{i}" for i, (a, b) in enumerate(MODULES))
    code = " | ".join(["has_msp::INT", *(f"CASE WHEN m{i} THEN 0 ELSE {1 << (i + 1)} END" for i in range(len(MODULES)))])
    return f""", {MOTIFS}, spanned AS (SELECT m.motif_id, f.fiber_id FROM motifs m JOIN fibers f ON m.chrom = f.chrom AND m.start > f.ref_start AND m."end" < f.ref_end),
    facts AS (SELECT s.motif_id, s.fiber_id, coalesce(bool_or(type = 'msp' AND r_start < m.start AND r_end > m."end"), FALSE) AS has_msp, coalesce(bool_or(type = 'msp' AND qual >= 229 AND r_start < m.start AND r_end > m."end"), FALSE) AS has_fire, coalesce(bool_or(type = 'nuc' AND r_start < m."end" AND r_end > m.start), FALSE) AS has_nuc, {marks}
    FROM spanned s JOIN motifs m USING (motif_id) LEFT JOIN annotations a ON a.fiber_id = s.fiber_id GROUP BY ALL), codes AS (SELECT motif_id, fiber_id, has_msp, has_fire, has_nuc, ({code})::INTEGER AS code FROM facts)"""


CODES = _codes_sql()


def codes(spark, d):
    return views.footprint_codes(motif_rows(spark, d), T.annotations(spark, d), MODULES, fibers=T.fibers(spark, d))


@query(CODES + " SELECT * FROM codes")
def footprint_codes(spark, d):
    return codes(spark, d)


@query(CODES + " SELECT motif_id, count(*) AS n_spanning_fibers, count(*) FILTER (has_msp) AS n_spanning_msps, count(*) FILTER (has_fire) AS n_spanning_fires, count(*) FILTER (has_nuc) AS n_overlapping_nucs, " + ", ".join(f"count(*) FILTER (code & 1 > 0 AND code & {1 << (i + 1)} > 0) AS module_{a}_{b}" for i, (a, b) in enumerate(MODULES)) + " FROM codes GROUP BY 1")
def footprint_counts(spark, d):
    return views.footprint_sums(motif_rows(spark, d), T.annotations(spark, d), MODULES, fibers=T.fibers(spark, d))


@query(CODES + " SELECT motif_id, fiber_id, code & 1 AS has_spanning_msp, module::INTEGER AS module, (code & (1 << (module + 1)::INTEGER) > 0)::INTEGER AS footprinted FROM codes, (SELECT unnest(range(0, 4)) AS module)")
def footprint_long(spark, d):
    return views.footprint_long(codes(spark, d), MODULES)


CENTERED = """, pairs AS (SELECT c.center_id, c.pos, c.strand AS center_strand, a.chrom, a.fiber_id, a.type, a.qual, CASE WHEN c.strand = '-' THEN -(r_end - pos) + 1 ELSE r_start - pos END AS centered_start, CASE WHEN c.strand = '-' THEN -(r_start - pos) + 1 ELSE r_end - pos END AS centered_end
FROM annotations a JOIN centers c ON a.chrom = c.chrom AND a.ref_start <= c.pos AND c.pos < a.ref_end)"""


@query(CENTERED + " SELECT chrom, center_id, pos, center_strand, fiber_id, type, qual, centered_start, centered_end FROM pairs")
def center_long(spark, d):
    return views.center_long(T.annotations(spark, d), T.centers(spark, d))


@query(CENTERED + " SELECT chrom, center_id, pos, center_strand, fiber_id, type, qual, centered_start, centered_end FROM pairs WHERE centered_end > -100 AND centered_start <= 100")
def center_long_dist(spark, d):
    return views.center_long(T.annotations(spark, d), T.centers(spark, d), 100)


@query(CENTERED + " SELECT chrom, center_id, pos, center_strand, fiber_id, " + ", ".join(f"coalesce(string_agg(centered_{s}, ',' ORDER BY centered_start, centered_end) FILTER (type = '{k}'), '') AS {k}_{s}s" for k in ("nuc", "msp", "m6a") for s in ("start", "end")) + " FROM pairs GROUP BY ALL")
def center_wide(spark, d):
    return views.center_wide(T.annotations(spark, d), T.centers(spark, d))


@query("SELECT c.center_id, f.fiber_id, CASE WHEN c.strand = '-' THEN -(ref_end - pos) + 1 ELSE ref_start - pos END AS centered_query_start, CASE WHEN c.strand = '-' THEN -(ref_start - pos) + 1 ELSE ref_end - pos END AS centered_query_end FROM fibers f JOIN centers c ON f.chrom = c.chrom AND ref_start <= pos AND pos < ref_end")
def center_spans(spark, d):
    return views.centered_span(intervals.spread(T.fibers(spark, d).select("fiber_id", "chrom", "ref_start", "ref_end")), T.centers(spark, d))


def bed12_sql(kind: str) -> str:
    return f"""SELECT chrom, ref_start AS start, ref_end AS "end", fiber_id AS name, 0 AS score, strand, ref_start AS thick_start, ref_end AS thick_end, '0,0,0' AS rgb, (count(*) + 2)::INTEGER AS block_count,
    '0,' || string_agg(r_end - r_start, ',' ORDER BY r_start, r_end) || ',1' AS block_sizes, '0,' || string_agg(r_start - ref_start, ',' ORDER BY r_start, r_end) || ',' || (ref_end - ref_start - 1) AS block_starts FROM annotations WHERE type = '{kind}' GROUP BY fiber_id, chrom, ref_start, ref_end, strand"""


for _kind in ("m6a", "nuc", "msp"):
    query(bed12_sql(_kind), f"bed12_{_kind}")(lambda spark, d, k=_kind: views.bed12(T.fibers(spark, d), T.annotations(spark, d), k))

WIDE = ", wide AS (SELECT fiber_id, " + ", ".join(f"coalesce(string_agg({c} || ',', '' ORDER BY q_start, length, qual, r_start) FILTER (type = '{k}'), '.') AS {k}_{n}" for k in ("m6a", "nuc", "msp") for c, n in (("q_start", "starts"), ("length", "lengths"), ("qual", "quals"), ("r_start", "ref_starts"))) + " FROM annotations GROUP BY 1)"
WIDE_NAMES = [f"{k}_{n}" for k in ("m6a", "nuc", "msp") for n in ("starts", "lengths", "quals", "ref_starts")]


@query(WIDE + " SELECT chrom, ref_start, ref_end, f.fiber_id, strand, hp, read_length, " + ", ".join(f"coalesce({n}, '.') AS {n}" for n in WIDE_NAMES) + " FROM fibers f LEFT JOIN wide w USING (fiber_id)")
def extract_all(spark, d):
    return views.extract_all(T.fibers(spark, d), T.annotations(spark, d))


@query("SELECT fiber_id, type, q_start AS start, length, r_start AS ref_start FROM annotations")
def extract_long(spark, d):
    return views.extract_long(views.extract_all(T.fibers(spark, d), T.annotations(spark, d)))


COLOR = "CASE " + " ".join(f"WHEN 100.0::DOUBLE - qual / 255.0::DOUBLE * 100.0::DOUBLE <= {b} THEN '{c}'" for b, c in scalars.FIRE_COLORS) + " END"


@query(f"SELECT fiber_id, fwd_start, qual, {COLOR} AS rgb FROM annotations WHERE type = 'msp'")
def fire_color(spark, d):
    return T.annotations(spark, d).where("type = 'msp'").select("fiber_id", "fwd_start", "qual", scalars.fire_color(F.col("qual")).alias("rgb"))


@query(f"""SELECT chrom, r_start AS start, r_end AS "end", fiber_id AS name, round(100.0::DOUBLE - qual / 255.0::DOUBLE * 100.0::DOUBLE, 4) AS fdr, hp, {COLOR} AS rgb FROM annotations WHERE type = 'msp' UNION ALL SELECT chrom, r_start, r_end, fiber_id, 101, hp, '169,169,169' FROM annotations WHERE type = 'nuc'""")
def fire_bed9(spark, d):
    a = T.annotations(spark, d)
    base = lambda kind, fdr, rgb: a.where(F.col("type") == kind).select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("fiber_id").alias("name"), fdr.alias("fdr"), "hp", rgb.alias("rgb"))
    fdr = F.round(F.lit(100.0) - F.col("qual") / F.lit(255.0) * 100.0, 4)
    return base("msp", fdr, scalars.fire_color(F.col("qual"))).unionByName(base("nuc", F.lit(101.0), F.lit("169,169,169")))


@query(f"""SELECT chrom, min(r_start) AS start, max(r_end) AS "end", 'msp' AS name, strand, rgb, count(*)::INTEGER AS block_count, string_agg(r_end - r_start, ',' ORDER BY r_start, r_end) AS block_sizes, string_agg(r_start - low, ',' ORDER BY r_start, r_end) AS block_starts, chrom || ':' || ref_start || '-' || ref_end || ':' || fiber_id AS decorated_item
FROM (SELECT *, {COLOR} AS rgb, min(r_start) OVER (PARTITION BY fiber_id, {COLOR}) AS low FROM annotations WHERE type = 'msp') GROUP BY chrom, fiber_id, ref_start, ref_end, strand, rgb""")
def decorator_blocks(spark, d):
    return views.decorators(T.annotations(spark, d), scalars.fire_color(F.col("qual")))


# Callers


@query("SELECT fiber_id, coalesce(p, -1) + 1 AS start, pos - coalesce(p, -1) - 1 AS length FROM (SELECT fiber_id, pos, lag(pos) OVER (PARTITION BY fiber_id ORDER BY pos) AS p FROM (SELECT DISTINCT fiber_id, fwd_start AS pos FROM marks)) WHERE pos - coalesce(p, -1) - 1 >= 75")
def nuc_simple_gap(spark, d):
    return calls.simple_gaps(T.marks(spark, d).select("fiber_id", F.col("fwd_start").alias("pos")).distinct())


@query("SELECT fiber_id, reach AS gap_start, fwd_start AS gap_end FROM (SELECT fiber_id, fwd_start, max(fwd_start + length) OVER (PARTITION BY fiber_id ORDER BY fwd_start, fwd_start + length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM marks WHERE type = 'nuc') WHERE fwd_start > reach")
def msp_between_nucs(spark, d):
    return calls.gaps_between(T.marks(spark, d).where("type = 'nuc'").select("fiber_id", F.col("fwd_start").alias("start"), (F.col("fwd_start") + F.col("length")).alias("end")))


def mark_lists(spark, d):
    lists = T.marks(spark, d).groupBy("fiber_id").agg(F.array_sort(F.collect_set("fwd_start")).alias("marks"))
    return lists.join(T.fibers(spark, d).select("fiber_id", "read_length"), "fiber_id")


def called(spark, d, options):
    rows = calls.call(mark_lists(spark, d), options)
    one = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("type"), x["start"].alias("start"), x["length"].alias("length")))
    return rows.select("fiber_id", F.inline(F.concat(one("nuc"), one("msp"))))  # one array of both: the caller runs once


def callers_sql(state: str, first: str, steps: str, after: str) -> str:
    """nuc and msp of ``walk``, a state a mark: ``k`` is the next mark's place, ``found`` the nucleosomes so far."""
    return f"""WITH RECURSIVE {T.SQL}, lists AS (SELECT fiber_id, read_length, list_sort(list_distinct(list(fwd_start))) AS m FROM marks JOIN fibers USING (fiber_id) GROUP BY ALL),
    walk({state}, k, found, fiber_id, read_length, m) AS (SELECT {first}, 1::BIGINT, []::STRUCT(s BIGINT, n BIGINT)[], fiber_id, read_length, m FROM lists UNION ALL SELECT {after}, fiber_id, read_length, m FROM ({steps})),
    nucs AS (SELECT fiber_id, i, found[i].s AS s, found[i].n AS n FROM (SELECT fiber_id, found, unnest(range(1, len(found) + 1)) AS i FROM walk WHERE k > len(m))),
    reached AS (SELECT fiber_id, s, greatest(m[1], coalesce(max(s + n) OVER (PARTITION BY fiber_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach FROM nucs JOIN lists USING (fiber_id)),
    tails AS (SELECT fiber_id, m[-1] + 1 AS s, greatest(m[1], coalesce((SELECT max(s + n) FROM nucs WHERE nucs.fiber_id = lists.fiber_id), 0)) AS reach FROM lists),
    made AS (SELECT fiber_id, 'nuc' AS type, s AS start, n AS length FROM nucs UNION ALL SELECT fiber_id, 'msp', reach, s - reach FROM (FROM reached UNION ALL FROM tails) WHERE reach > 0 AND s > reach)
    SELECT made.* FROM made JOIN lists USING (fiber_id) WHERE start >= 45 AND start + length <= read_length - 45"""


GREEDY = callers_sql(
    "grown, made",
    "0::BIGINT, FALSE",
    """SELECT *, CASE rule WHEN 0 THEN own WHEN 2 THEN own WHEN 4 THEN grown + own + ahead + 2 ELSE grown + own + 1 END AS size FROM (SELECT *, CASE WHEN inside AND grown + own + 1 >= 100 AND least(grown, own) < 75 AND least(grown, own) >= 25 AND greatest(grown, own) <= 125 THEN 1 WHEN own >= 75 THEN 2
    WHEN inside AND grown + own + 1 >= 100 AND grown < 75 AND NOT (ahead > grown AND ahead < 75) THEN 3 WHEN inside AND ahead > 0 AND ahead < 75 AND grown < 75 AND grown + own + ahead + 2 >= 100 AND own + ahead + 1 < 100 THEN 4 ELSE 0 END AS rule
    FROM (SELECT *, m[k] - CASE WHEN k = 1 THEN -1 ELSE m[k - 1] END - 1 AS own, coalesce(m[k + 1] - m[k] - 1, 0) AS ahead, k > 1 AND m[k - 1] > 0 AS inside FROM walk WHERE k <= len(m)))""",
    "size, rule > 0, k + CASE WHEN rule = 4 THEN 2 ELSE 1 END, CASE WHEN rule = 0 THEN found ELSE list_append(CASE WHEN rule = 1 AND made THEN found[:len(found) - 1] ELSE found END, {'s': m[k + CASE WHEN rule = 4 THEN 1 ELSE 0 END] - size, 'n': size}) END",
)
DSEGMENT = callers_sql(
    "total, best, start, stop",
    "0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT",
    """SELECT *, b >= 75 OR t - 1 <= 0 OR t - 1 <= b - 1 AS closed FROM (SELECT *, CASE WHEN t >= best AND gap > 0 THEN t ELSE best END AS b, CASE WHEN t >= best AND gap > 0 THEN m[k] ELSE stop END AS e FROM (SELECT * REPLACE (CASE WHEN total = 0 THEN last + 1 ELSE start END AS start), total + gap AS t
    FROM (SELECT *, m[k] - last - 1 AS gap FROM (SELECT *, CASE WHEN k = 1 THEN -1 ELSE m[k - 1] END AS last FROM walk WHERE k <= len(m)))))""",
    "CASE WHEN closed THEN 0 ELSE t - 1 END, CASE WHEN closed THEN 0 ELSE b END, CASE WHEN closed THEN m[k] + 1 ELSE start END, CASE WHEN closed THEN m[k] + 1 ELSE e END, k + 1, CASE WHEN b >= 75 THEN list_append(found, {'s': start, 'n': e - start}) ELSE found END",
)


@query(GREEDY)
def nucleosomes_greedy(spark, d):
    return called(spark, d, calls.NucleosomeOptions())


@query(DSEGMENT)
def nucleosomes_dsegment(spark, d):
    return called(spark, d, calls.NucleosomeOptions(skips=2))


@query(None)
def fire_features(spark, d):
    docs = T.table(spark, d, "documents")
    letters = F.translate(F.upper(F.regexp_replace("text", "[^a-zA-Z]", "")), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    texts = docs.select(F.col("doc_id").alias("text_id"), letters.alias("letters")).where("letters <> ''")
    rows = T.annotations(spark, d).groupBy("fiber_id", "read_length").agg(F.array_sort(F.collect_set(F.when(F.col("type") == "m6a", F.col("q_start")))).alias("marks"), F.collect_list(F.when(F.col("type") == "msp", F.struct(F.col("q_start").alias("start"), "length"))).alias("msps"))
    # a text's letters, repeated, make a molecule of its own length; a text without letters makes ACGT
    own = rows.withColumn("text_id", F.col("fiber_id") % docs.count()).join(texts, "text_id", "left").withColumn("letters", F.coalesce("letters", F.lit("ACGT")))
    return stats.features(own.withColumn("seq", F.rpad("letters", F.col("read_length").cast("int"), F.col("letters"))), least=85)


# Interval algebra

SPANS = "spans AS (SELECT chrom, r_start AS s, r_end AS e FROM annotations WHERE type = '{}')"


def spans(spark, d, kind):
    return T.annotations(spark, d).where(F.col("type") == kind).select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"))


def merged_sql(source: str, distance: int) -> str:
    return f"SELECT chrom, min(s) AS start, max(e) AS \"end\" FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {distance} THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY chrom, i"


@query(f", {SPANS.format('nuc')} {merged_sql('spans', 0)}")
def merge_intervals(spark, d):
    return intervals.merge(spans(spark, d, "nuc"))


@query(f", {SPANS.format('nuc')} {merged_sql('spans', 147)}")
def merge_intervals_distance(spark, d):
    return intervals.merge(spans(spark, d, "nuc"), 147)


BASES = "bases AS (SELECT DISTINCT chrom, unnest(range(r_start, r_end)) AS p, type FROM annotations WHERE type <> 'm6a'), left_over AS (SELECT chrom, p FROM bases WHERE type = 'nuc' EXCEPT SELECT chrom, p FROM bases WHERE type = 'msp')"


@query(f", {BASES} SELECT chrom, min(p) AS start, max(p) + 1 AS \"end\" FROM (SELECT *, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS i FROM left_over) GROUP BY chrom, i")
def subtract_intervals(spark, d):
    return intervals.subtract(spans(spark, d, "nuc"), spans(spark, d, "msp"))


@query(f", {SPANS.format('nuc')}, {CONTIGS}, free AS (SELECT chrom, unnest(range(0, length)) AS p FROM contigs EXCEPT SELECT chrom, unnest(range(s, e)) FROM spans) SELECT chrom, min(p) AS start, max(p) + 1 AS \"end\" FROM (SELECT *, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS i FROM free) GROUP BY chrom, i")
def complement_intervals(spark, d):
    return intervals.complement(spans(spark, d, "nuc"), contigs(spark, d))


@query(f""", {CONTIGS} SELECT * EXCLUDE (s) REPLACE (s AS start, s + "end" - start AS "end") FROM (SELECT r.*, replica::INTEGER AS replica, ('0x' || substr(md5(region_id || '|42|' || replica), 1, 15))::BIGINT % greatest(length - ("end" - start) + 1, 1) AS s FROM regions r JOIN contigs USING (chrom), (SELECT unnest([1, 2]) AS replica))""")
def shuffle_intervals(spark, d):
    return intervals.shuffle(T.regions(spark, d), contigs(spark, d), F.col("region_id"), replicas=2)


@query("SELECT type, fiber_id, fwd_start, length FROM marks WHERE type IN ('msp', 'nuc')")
def union_msp_nuc(spark, d):
    one = lambda k: T.marks(spark, d).where(F.col("type") == k).select("type", "fiber_id", "fwd_start", "length")
    return one("msp").unionByName(one("nuc"))


@query(f"SELECT {ANNOTATION} FROM marks m WHERE fwd_start < 900 OR NOT EXISTS (SELECT 1 FROM marks o WHERE o.fiber_id = m.fiber_id AND o.type = m.type AND o.fwd_start < 900)")
def merge_missing_types(spark, d):
    m = T.marks(spark, d)
    return codec.merge_missing(m.where("fwd_start < 900"), m.where("fwd_start >= 900"))


# Codecs and scalars


def ma_rows(spark, d):
    own = T.marks(spark, d).join(T.fibers(spark, d).select("fiber_id", "read_length"), "fiber_id")
    return own.withColumn("spec", F.when(F.col("type") == "nuc", "").otherwise("Q")).withColumn("strand_mark", F.lit("+")).withColumn("quals", F.when(F.col("type") == "nuc", F.array().cast("array<int>")).otherwise(F.array("qual")))


@query("""SELECT fiber_id, read_length || ';' || string_agg(type || '+' || CASE WHEN type = 'nuc' THEN '' ELSE 'Q' END || ':' || items, ';' ORDER BY type) AS ma, coalesce(string_agg(aq, ',' ORDER BY type) FILTER (type <> 'nuc'), '') AS aq FROM (SELECT fiber_id, read_length, type, string_agg((fwd_start + 1) || '-' || length, ',' ORDER BY fwd_start, length, CASE WHEN type = 'nuc' THEN 0 ELSE qual END) AS items, string_agg(qual, ',' ORDER BY fwd_start, length, qual) AS aq FROM flipped GROUP BY ALL) GROUP BY fiber_id, read_length""")
def ma_emit(spark, d):
    return codec.emit_ma(ma_rows(spark, d)).select("fiber_id", "ma", F.array_join(F.transform("aq", lambda q: q.cast("string")), ",").alias("aq"))


@query("SELECT fiber_id, type, fwd_start, length, CASE WHEN type = 'nuc' THEN NULL ELSE qual END AS qual FROM flipped")
def ma_parse(spark, d):
    return codec.parse_ma(codec.emit_ma(ma_rows(spark, d))).select("fiber_id", "type", "fwd_start", "length", F.get("quals", F.lit(0)).alias("qual"))


def mm_rows(spark, d):
    seq = F.translate(F.upper(F.regexp_replace("text", "[^a-zA-Z]", "")), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    docs = T.table(spark, d, "documents").select("doc_id", seq.alias("seq"))
    at = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.when((c == "A") & (i % 7 == 0), F.struct(F.lit("A").alias("base"), F.lit("+").alias("strand"), F.lit("a").alias("code"), i.alias("pos"), (i % 256).alias("qual")))), lambda x: x.isNotNull())
    return docs.withColumn("marks", at)


SEQ = "(SELECT doc_id, translate(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS seq FROM documents)"


@query(f"""SELECT doc_id, coalesce('A+a' || string_agg(',' || (rank - coalesce(before, 0) - 1), '' ORDER BY i) || ';', '') AS mm, coalesce(list((i % 256)::INTEGER ORDER BY i) FILTER (i IS NOT NULL), []) AS ml FROM documents d LEFT JOIN (SELECT doc_id, i, rank, lag(rank) OVER (PARTITION BY doc_id ORDER BY i) AS before
FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM (SELECT doc_id, seq, unnest(range(0, length(seq))) AS i FROM {SEQ}) WHERE seq[i + 1] = 'A') WHERE i % 7 = 0) USING (doc_id) GROUP BY doc_id""")
def mm_emit(spark, d):
    return mm_rows(spark, d).select("doc_id", codec.emit_mm("marks", "seq").alias("t")).select("doc_id", "t.mm", "t.ml")


@query(f"SELECT doc_id, i::INTEGER AS pos, (i % 256)::INTEGER AS qual FROM (SELECT doc_id, seq, unnest(range(0, length(seq), 7)) AS i FROM {SEQ}) WHERE substr(seq, (i + 1)::BIGINT, 1) = 'A'")
def mm_parse(spark, d):
    rows = mm_rows(spark, d).withColumn("t", codec.emit_mm("marks", "seq"))
    return rows.select("doc_id", F.explode(codec.parse_mm("t.mm", "t.ml", "seq")).alias("m")).select("doc_id", "m.pos", "m.qual")


def seqs(spark, d):
    return mm_rows(spark, d).select("doc_id", "seq")


@query(f"SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM {SEQ}")
def revcomp(spark, d):
    return seqs(spark, d).select("doc_id", F.md5(scalars.revcomp(F.col("seq"))).alias("digest"))


@query(f"SELECT doc_id, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'T', '')) AS t FROM {SEQ}")
def base_counts(spark, d):
    return seqs(spark, d).select("doc_id", scalars.count_base(F.col("seq"), "A").cast("bigint").alias("a"), scalars.count_base(F.col("seq"), "T").cast("bigint").alias("t"))


@query("SELECT doc_id, md5(replace(replace(coalesce(text, ''), '%', '%25'), ',', '%2C')) AS digest, TRUE AS same FROM documents")
def percent_codec(spark, d):
    text = F.coalesce("text", F.lit(""))
    coded = scalars.percent_encode(text)
    return T.table(spark, d, "documents").select("doc_id", F.md5(coded).alias("digest"), (scalars.percent_decode(coded) == text).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS contig FROM part")
def pansn_strip(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("HG1#"), F.col("p_name"))).otherwise(F.concat(F.lit("HG1#1#"), F.col("p_name")))
    return T.table(spark, d, "part").select("p_partkey", scalars.strip_prefix(name).alias("contig"))


@query("SELECT x, (CASE WHEN x < 64 THEN x WHEN x < 191 THEN floor((x - 64) / 2) + 64 WHEN x < 445 THEN floor((x - 192) / 4) + 128 WHEN x < 953 THEN floor((x - 448) / 8) + 192 ELSE 255 END)::INTEGER AS code FROM (SELECT l_partkey % 1200 AS x FROM lineitem)")
def kinetics_u16(spark, d):
    return T.table(spark, d, "lineitem").select((F.col("l_partkey") % 1200).alias("x")).select("x", scalars.kinetics_to_u8(F.col("x")).alias("code"))


@query("SELECT fiber_id, chrom, string_agg(r_start || '-' || r_end, ',' ORDER BY r_start, r_end) AS spans FROM annotations WHERE type = 'msp' GROUP BY fiber_id, chrom")
def mock_fire_group(spark, d):
    items = F.array_sort(F.collect_list(F.struct("r_start", "r_end")))
    return T.annotations(spark, d).where("type = 'msp'").groupBy("fiber_id", "chrom").agg(F.array_join(F.transform(items, lambda x: F.concat(x["r_start"].cast("string"), F.lit("-"), x["r_end"].cast("string"))), ",").alias("spans"))


@query("SELECT fiber_id, count(*) FILTER (type = 'nuc') AS nuc, count(*) FILTER (type = 'msp') AS msp, count(*) FILTER (type = 'm6a') AS m6a FROM marks GROUP BY 1")
def pivot_type_counts(spark, d):
    return T.marks(spark, d).groupBy("fiber_id").pivot("type", ["nuc", "msp", "m6a"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT * EXCLUDE (h, least) FROM (SELECT l.*, md5(concat_ws('|', coalesce(doc_id::VARCHAR, '-'), coalesce(quality::VARCHAR, '-'), coalesce(toxic::VARCHAR, '-'), '42')) AS h, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS least FROM labels l) QUALIFY row_number() OVER (PARTITION BY quality ORDER BY h) <= least")
def balance_labels(spark, d):
    return stats.balance(T.table(spark, d, "labels"), "quality")


from spanforge.plans import more  # noqa: E402, F401  registers its queries
