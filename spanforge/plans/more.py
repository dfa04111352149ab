"""More queries of the catalogue: the fourth mark type, wide extracts, tag edits, small conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import codec, scalars
from spanforge.operators import intervals, kinetics, peaks, tags, views
from spanforge.operators.pileup import PileupOptions, pileup
from spanforge.plans.catalogue import ANNOTATION, CONTIGS, MOTIFS, ONE, QUERIES, SEQ, WITH, as_b, as_intervals, bed12_sql, codes, contigs, motif_rows, mm_rows, moved, pileup_sql, query
from spanforge.plans.catalogue import CODES as CODES_SQL
from spanforge.sources import tables as T
from spanforge.sources.written import materialize

CPG = """, cpg AS (SELECT event_id % 997 + 1 AS fiber_id, 'cpg' AS type, (event_id * 37 + user_id * 11) % 1800 AS fwd_start, 1::BIGINT AS length, ((event_id * 5 + user_id) % 256)::INTEGER AS qual FROM events),
four AS (SELECT * FROM annotations UNION ALL BY NAME SELECT *, ref_start + q_start AS r_start, ref_start + q_end AS r_end FROM (SELECT m.*, f.chrom, f.ref_start, f.ref_end, f.read_length, f.strand, f.hp, CASE WHEN strand = '-' THEN read_length - fwd_start - length ELSE fwd_start END AS q_start, CASE WHEN strand = '-' THEN read_length - fwd_start ELSE fwd_start + length END AS q_end FROM cpg m JOIN fibers f USING (fiber_id)))"""


def four(spark, d):
    return T.annotations(spark, d, cpg=True)


# The fourth type


@query(f"{CPG} SELECT {ANNOTATION} FROM four WHERE type NOT IN ('m6a', 'cpg') OR qual >= 125")
def filter_min_ml_cpg(spark, d):
    from spanforge.operators import filters

    return filters.min_quality(four(spark, d)).select(*ANNOTATION.split(", "))


@query(CPG + pileup_sql(PileupOptions(m6a=True, cpg=True), annotations="four"))
def pileup_cpg(spark, d):
    return pileup(T.fibers(spark, d), four(spark, d), PileupOptions(m6a=True, cpg=True))


@query(CPG + " " + bed12_sql("cpg").replace("FROM annotations", "FROM four"))
def bed12_cpg(spark, d):
    return views.bed12(T.fibers(spark, d), four(spark, d), "cpg")


@query("""SELECT fiber_id::VARCHAR AS chrom, 0::BIGINT AS start, read_length AS "end", fiber_id AS name, 0 AS score, strand, 0::BIGINT AS thick_start, read_length AS thick_end, '0,0,0' AS rgb, (count(*) + 2)::INTEGER AS block_count,
'0,' || string_agg(length, ',' ORDER BY fwd_start, length) || ',1' AS block_sizes, '0,' || string_agg(fwd_start, ',' ORDER BY fwd_start, length) || ',' || (read_length - 1) AS block_starts FROM annotations WHERE type = 'nuc' GROUP BY fiber_id, read_length, strand""")
def bed12_molecular(spark, d):
    return views.bed12(T.fibers(spark, d), T.annotations(spark, d), "nuc", reference=False)


@query(CPG + """, pairs AS (SELECT c.center_id, c.pos, c.strand AS center_strand, a.chrom, a.fiber_id, a.type, CASE WHEN c.strand = '-' THEN -(r_end - pos) + 1 ELSE r_start - pos END AS centered_start, CASE WHEN c.strand = '-' THEN -(r_start - pos) + 1 ELSE r_end - pos END AS centered_end
FROM four a JOIN centers c ON a.chrom = c.chrom AND a.ref_start <= c.pos AND c.pos < a.ref_end) SELECT chrom, center_id, pos, center_strand, fiber_id, """ + ", ".join(f"coalesce(string_agg(centered_{s}, ',' ORDER BY centered_start, centered_end) FILTER (type = '{k}'), '') AS {k}_{s}s" for k in ("nuc", "msp", "m6a", "cpg") for s in ("start", "end")) + " FROM pairs GROUP BY ALL")
def center_wide_cpg(spark, d):
    return views.center_wide(four(spark, d), T.centers(spark, d), kinds=("nuc", "msp", "m6a", "cpg"))


# Extraction

FACTS = "(SELECT *, fiber_id % 160 / 8.0::DOUBLE AS ec, 'rg' || fiber_id % 3 AS rg, CASE WHEN fiber_id % 4 = 0 THEN '.' ELSE '0.99' END AS rq, read_length // 2 AS at_bp FROM fibers)"


def _lists() -> str:
    out = []
    for name, own, fields in (("nuc", "type = 'nuc'", "starts lengths"), ("msp", "type = 'msp'", "starts lengths"), ("fire", "type = 'msp' AND qual >= 229", "starts lengths qual"), ("m6a", "type = 'm6a'", ""), ("5mC", "type = 'cpg'", "")):
        columns = {name: "q_start", f"ref_{name}": "r_start", f"{name}_qual": "qual"} if not fields else {f"{name}_starts": "q_start", f"{name}_lengths": "length", **({f"{name}_qual": "qual"} if "qual" in fields else {}), f"ref_{name}_starts": "r_start", f"ref_{name}_lengths": "r_end - r_start"}
        out += [f"coalesce(string_agg(({c}) || ',', '' ORDER BY q_start, length, qual, r_start) FILTER ({own}), '.') AS \"{n}\"" for n, c in columns.items()]
    return ", ".join(out)


LIST_NAMES = [x.split('"')[1] for x in _lists().split(" AS ")[1:]]


@query(f"""{CPG}, wide AS (SELECT fiber_id, count(*) FILTER (type = 'm6a') AS total_m6a_bp, coalesce(sum(length) FILTER (type = 'nuc'), 0)::BIGINT AS total_nuc_bp, coalesce(sum(length) FILTER (type = 'msp'), 0)::BIGINT AS total_msp_bp, count(*) FILTER (type = 'cpg') AS "total_5mC_bp", {_lists()} FROM four GROUP BY 1)
SELECT chrom AS ct, ref_start AS st, ref_end AS en, f.fiber_id AS fiber, round(ec)::BIGINT AS score, strand, flag AS sam_flag, hp AS HP, rg AS RG, read_length AS fiber_length, ec, rq, at_bp AS "total_AT_bp", coalesce(total_m6a_bp, 0) AS total_m6a_bp, coalesce(total_nuc_bp, 0) AS total_nuc_bp, coalesce(total_msp_bp, 0) AS total_msp_bp, coalesce("total_5mC_bp", 0) AS "total_5mC_bp", {', '.join(f"coalesce({chr(34)}{n}{chr(34)}, '.') AS {chr(34)}{n}{chr(34)}" for n in LIST_NAMES)} FROM {FACTS} f LEFT JOIN wide USING (fiber_id)""")
def extract_wide(spark, d):
    i = F.col("fiber_id")
    f = T.fibers(spark, d).withColumn("ec", (i % 160) / F.lit(8.0)).withColumn("rg", F.concat(F.lit("rg"), (i % 3).cast("string"))).withColumn("rq", F.when(i % 4 == 0, ".").otherwise("0.99")).withColumn("at_bp", F.expr("read_length div 2"))
    return views.extract_wide(f, four(spark, d))


SEQUENCE = "substr(repeat('ACGTTGCAAC', 600), 1 + (fiber_id % 10)::INTEGER, read_length::INTEGER)"


@query(f"""SELECT center_id, fiber_id, CASE WHEN back THEN reverse(translate(piece, 'ACGT', 'TGCA')) ELSE piece END AS bases FROM (SELECT center_id, fiber_id, c.strand = '-' AS back, substr(repeat('N', 20) || {SEQUENCE} || repeat('N', 20), (pos - ref_start + 1)::INTEGER, 41) AS piece FROM fibers f JOIN centers c ON f.chrom = c.chrom AND ref_start <= pos AND pos < ref_end)""")
def center_sequence(spark, d):
    forth, back = views.both_ways(F.expr(SEQUENCE), 20)
    f = intervals.spread(T.fibers(spark, d).select("fiber_id", "chrom", "read_length", F.col("ref_start").alias("start"), F.col("ref_end").alias("end")))
    f = f.select("fiber_id", "chrom", "start", "end", forth.alias("forth"), back.alias("back"))
    pairs = intervals.point_join(f, views.center_points(T.centers(spark, d)))
    bases = views.piece_of(F.col("forth"), F.col("back"), F.col("pos") - F.col("start"), 20, F.col("center_strand") == "-")
    return pairs.select("center_id", "fiber_id", bases.alias("bases"))


@query(CODES_SQL + " SELECT motif_id, string_agg(fiber_id, ',' ORDER BY fiber_id) AS fiber_ids, string_agg(code, ',' ORDER BY fiber_id) AS codes, string_agg(has_fire::INTEGER, ',' ORDER BY fiber_id) AS fires FROM codes GROUP BY 1")
def footprint_lists(spark, d):
    items = F.array_sort(F.collect_list(F.struct("fiber_id", "code", F.col("has_fire").cast("int").alias("fire"))))
    text = lambda field: F.array_join(F.transform(items, lambda x: x[field].cast("string")), ",")
    return codes(spark, d).groupBy("motif_id").agg(text("fiber_id").alias("fiber_ids"), text("code").alias("codes"), text("fire").alias("fires"))


# Tracks


@query(f"WITH runs AS ({WITH + pileup_sql(ONE)}) SELECT chrom, sum(coverage * (\"end\" - start))::BIGINT AS coverage, sum(fire_coverage * (\"end\" - start))::BIGINT AS fire_coverage, round(sum(CASE WHEN score >= 0 THEN round(score * 1000000)::BIGINT * (\"end\" - start) ELSE 0 END) / 1000000.0::DOUBLE, 3) AS score FROM runs GROUP BY chrom")
def track_totals(spark, d):
    n = F.col("end") - F.col("start")
    runs = pileup(T.fibers(spark, d), T.annotations(spark, d), ONE)
    score = F.sum(F.when(F.col("score") >= 0, F.round(F.col("score") * 1000000).cast("bigint") * n).otherwise(0)) / F.lit(1000000.0)
    return runs.groupBy("chrom").agg(F.sum(F.col("coverage") * n).alias("coverage"), F.sum(F.col("fire_coverage") * n).alias("fire_coverage"), F.round(score, 3).alias("score"))


RANGE = f"""WITH real AS ({WITH + pileup_sql(ONE)}), k AS (SELECT chrom, coverage, sum("end" - start) AS w FROM real GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY chrom ORDER BY coverage) AS cum, sum(w) OVER (PARTITION BY chrom) AS total FROM k),
limits AS (SELECT chrom, greatest(4, round(m - 5 * s)) AS least, round(m + 5 * s) AS most FROM (SELECT chrom, (min(coverage) FILTER (cum * 2 >= total) + min(coverage) FILTER (cum * 2 > total)) / 2.0::DOUBLE AS m, sqrt(greatest(0, sum(w * coverage * coverage) / sum(w)::DOUBLE - (sum(w * coverage) / sum(w)::DOUBLE) ** 2)) AS s FROM c GROUP BY chrom))"""


def coverage_limits(runs):
    """chrom, least, most: five standard deviations of the coverage about its median, 4 at least."""
    w, c = F.col("end") - F.col("start"), F.col("coverage")
    spread = runs.groupBy("chrom").agg(F.sum(w).alias("w"), F.sum(w * c).alias("wc"), F.sum(w * c * c).alias("wcc"))
    spread = spread.select("chrom", F.sqrt(F.greatest(F.lit(0.0), F.col("wcc") / F.col("w") - F.pow(F.col("wc") / F.col("w"), 2))).alias("sd"))
    limits = intervals.weighted_median(runs.withColumn("w", w), "coverage", "w", ["chrom"]).join(spread, "chrom")
    return limits.select("chrom", F.greatest(F.lit(4.0), F.round(F.col("median") - F.lit(5) * F.col("sd"))).alias("least"), F.round(F.col("median") + F.lit(5) * F.col("sd")).alias("most"))


@query(RANGE + " SELECT real.chrom, start, \"end\", coverage, score FROM real JOIN limits ON real.chrom = limits.chrom WHERE coverage >= least AND coverage <= most")
def coverage_range(spark, d):
    """Runs whose coverage is within the chromosome's limits."""
    runs = pileup(T.fibers(spark, d), T.annotations(spark, d), ONE)
    return runs.join(coverage_limits(runs), "chrom").where("coverage >= least and coverage <= most").select("chrom", "start", "end", "coverage", "score")


@query(None)
def peaks_table(spark, d):
    """All columns of the merged peaks; the track with haplotypes is written once."""
    runs = materialize(pileup(T.fibers(spark, d), T.annotations(spark, d), PileupOptions(haps=True, min_fire_coverage=ONE.min_fire_coverage)), "pk-haps")
    return peaks.as_text(peaks.peak_table(QUERIES["peaks_merged"](spark, d), runs, coverage_limits(runs)))


# Rows by rows


@query("SELECT a.fiber_id, a.type, a.q_start, n.n FROM annotations a JOIN (SELECT fiber_id, type, count(*) AS n FROM annotations GROUP BY ALL) n ON a.fiber_id = n.fiber_id AND a.type = n.type")
def long_type_counts(spark, d):
    a = T.annotations(spark, d).select("fiber_id", "type", "q_start")
    return a.join(a.groupBy("fiber_id", "type").agg(F.count("*").alias("n")), ["fiber_id", "type"])


GAPS = ", steps AS (SELECT fiber_id, q_start - lag(q_start) OVER (PARTITION BY fiber_id ORDER BY q_start) AS gap FROM annotations WHERE type = 'm6a')"


def gaps(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("fiber_id").orderBy("q_start")
    return T.annotations(spark, d).where("type = 'm6a'").select("fiber_id", (F.col("q_start") - F.lag("q_start").over(by)).alias("gap"), "read_length").where("gap is not null")


@query(GAPS + " SELECT * FROM steps WHERE gap IS NOT NULL")
def mark_gaps(spark, d):
    return gaps(spark, d).drop("read_length")


@query(GAPS + " SELECT fiber_id, round(sum(gap * gap) / any_value(read_length)::DOUBLE, 6) AS weighted, list_sort(list(gap))[count(*) // 2 + 1] AS median FROM steps JOIN fibers USING (fiber_id) WHERE gap IS NOT NULL GROUP BY fiber_id")
def run_length_stats(spark, d):
    items = F.array_sort(F.collect_list("gap"))
    return gaps(spark, d).groupBy("fiber_id", "read_length").agg(F.sum(F.col("gap") * F.col("gap")).alias("w"), items.alias("i")).select("fiber_id", F.round(F.col("w") / F.col("read_length"), 6).alias("weighted"), F.get("i", F.expr("size(i) div 2")).alias("median"))


@query("SELECT fiber_id, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS names FROM marks GROUP BY 1")
def annotation_totals(spark, d):
    return T.marks(spark, d).groupBy("fiber_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("names"))


@query(f', {MOTIFS} SELECT region_id FROM regions r WHERE EXISTS (SELECT 1 FROM motifs m WHERE m.chrom = r.chrom AND m.start < r."end" AND r.start < m."end")')
def region_motif_semi(spark, d):
    return intervals.overlap_semi(T.regions(spark, d), as_b(motif_rows(spark, d)), ["region_id"]).select("region_id")


@query(f', {MOTIFS} SELECT region_id FROM regions r WHERE NOT EXISTS (SELECT 1 FROM motifs m WHERE m.chrom = r.chrom AND m.start < r."end" AND r.start < m."end")')
def region_motif_anti(spark, d):
    return intervals.overlap_semi(T.regions(spark, d), as_b(motif_rows(spark, d)), ["region_id"], anti=True).select("region_id")


@query("SELECT region_id FROM regions WHERE chrom IN ('chr1', 'chr3') AND NOT regexp_matches(name, '#[13]')")
def regions_whitelisted(spark, d):
    kept = spark.createDataFrame([("chr1",), ("chr3",)], "chrom string")
    return T.regions(spark, d).join(F.broadcast(kept), "chrom", "left_semi").where(~F.col("name").rlike("#[13]")).select("region_id")


@query("SELECT region_id FROM (SELECT region_id, md5(region_id || '|42') AS h FROM regions) ORDER BY h LIMIT 100")
def random_top(spark, d):
    return T.regions(spark, d).select("region_id", F.md5(F.concat(F.col("region_id").cast("string"), F.lit("|42"))).alias("h")).orderBy("h").limit(100).select("region_id")


@query("SELECT chrom, r_start AS start, r_end AS \"end\", fiber_id, type, row_number() OVER (PARTITION BY chrom ORDER BY r_start, r_end, fiber_id, type) AS place FROM (SELECT DISTINCT chrom, r_start, r_end, fiber_id, type FROM annotations)")
def sorted_output(spark, d):
    """By place; a row's place in its chromosome, counted inside tiles and along them, shows the order."""
    rows = T.annotations(spark, d).select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"), "fiber_id", "type").distinct()
    from pyspark.sql import Window

    tile = F.floor(F.col("start") / 5000)
    counts = rows.groupBy("chrom", tile.alias("t")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chrom").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("chrom").alias("c"), F.col("t").alias("ct"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("chrom", "t").orderBy("start", "end", "fiber_id", "type"))
    placed = rows.withColumn("t", tile).withColumn("own", own).join(counts, (F.col("chrom") == F.col("c")) & (F.col("t") == F.col("ct")))
    return placed.select("chrom", "start", "end", "fiber_id", "type", (F.col("before") + F.col("own")).alias("place")).orderBy("chrom", "place")


# Tags and conversions


@query("SELECT fiber_id, type, fwd_start, length, qual FROM (SELECT fiber_id, type, fwd_start, length, CASE WHEN type = 'msp' THEN qual END AS qual FROM marks WHERE type IN ('nuc', 'msp') UNION ALL SELECT fiber_id, 'fire', fwd_start, length, qual FROM marks WHERE type = 'msp' AND qual > 0)")
def convert_tags(spark, d):
    """Legacy arrays as tables of types: the tables are made from the marks first."""
    items = lambda k: F.array_sort(F.collect_list(F.when(F.col("type") == k, F.struct("fwd_start", "length", "qual"))))
    reads = T.marks(spark, d).groupBy("fiber_id").agg(items("nuc").alias("n"), items("msp").alias("a"))
    reads = reads.select("fiber_id", F.col("n.fwd_start").alias("ns"), F.col("n.length").alias("nl"), F.col("a.fwd_start").alias("as"), F.col("a.length").alias("al"), F.col("a.qual").alias("aq"))
    return tags.convert_legacy(reads)


@query("SELECT fiber_id, chrom, CASE WHEN flag & 256 = 0 AND fiber_id % 61 >= 20 THEN CASE WHEN chrom IN ('chr1', 'chr2') THEN 1 WHEN chrom = 'chr3' THEN 2 END END AS HP FROM fibers")
def haplotag(spark, d):
    haps = spark.createDataFrame([("chr1", 1), ("chr2", 1), ("chr3", 2)], "chrom string, hap int")
    return tags.haplotag(T.fibers(spark, d).withColumn("mapq", F.col("fiber_id") % 61).withColumn("HP", F.lit(9)), F.broadcast(haps), 20).select("fiber_id", "chrom", "HP")


HEADERS = "(SELECT CASE n_nationkey % 4 WHEN 0 THEN 'HD' WHEN 1 THEN 'SQ' WHEN 2 THEN 'RG' ELSE 'PG' END AS type, n_name AS line, n_nationkey < 12 AS own FROM nation)"


@query(f"SELECT type, line FROM {HEADERS} WHERE own AND NOT (type = 'RG' AND EXISTS (SELECT 1 FROM {HEADERS} WHERE NOT own AND type = 'RG')) UNION ALL SELECT type, line FROM {HEADERS} WHERE NOT own AND type NOT IN ('HD', 'SQ')")
def header_merge(spark, d):
    k = F.col("n_nationkey")
    rows = T.table(spark, d, "nation").select(F.when(k % 4 == 0, "HD").when(k % 4 == 1, "SQ").when(k % 4 == 2, "RG").otherwise("PG").alias("type"), F.col("n_name").alias("line"), (k < 12).alias("own"))
    return tags.merge_headers(rows.where("own").drop("own"), rows.where("not own").drop("own"))


@query("SELECT o_orderkey, list_aggregate(list_transform(range(0, 1 + (o_orderkey % 5)), lambda i: chr((33 + (o_orderkey * 7 + i * 11) % 94)::INTEGER)), 'string_agg', '') AS quality FROM orders")
def phred_string(spark, d):
    k = F.col("o_orderkey")
    quals = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 5), lambda i: (k * 7 + i * 11) % 94)
    return T.table(spark, d, "orders").select("o_orderkey", tags.phred_text(quals).alias("quality"))


@query("SELECT p_partkey, p_size + CASE WHEN p_partkey % 50 > 0 THEN round((p_partkey % 40) * p_size / (p_partkey % 50)::DOUBLE) ELSE 0 END::BIGINT AS n FROM part")
def imputed_counts(spark, d):
    k = F.col("p_partkey")
    return T.table(spark, d, "part").select("p_partkey", tags.imputed(F.col("p_size"), k % 50, k % 40).alias("n"))


@query("SELECT event_id, ml FROM (SELECT event_id, (event_id * 13) % 1001 AS s, event_id % 90 AS pos, CASE WHEN s <= 250 THEN 0 WHEN s <= 700 THEN 200 ELSE 255 END AS ml FROM events) WHERE ml >= 150 AND pos >= 7 AND pos < 93")
def calls_from_scores(spark, d):
    table = spark.createDataFrame([(0, 0), (500, 200), (900, 255)], "key bigint, value int")
    rows = T.table(spark, d, "events").select("event_id", (((F.col("event_id") * 13) % 1001) / F.lit(1000.0)).alias("score"), (F.col("event_id") % 90).alias("pos"), F.lit(100).alias("read_length"))
    return tags.calls_from_scores(rows, table, 150).select("event_id", "ml")


@query(None)
def mock_windows(spark, d):
    items = T.regions(spark, d).select("chrom", "start", "end")
    return tags.mock_windows(items, contigs(spark, d), 3000)


@query("SELECT doc_id, md5(translate(text, 'acgtn', 'ACGTN')) AS upper, list_aggregate(list_transform(string_split(left(text, 8), ''), lambda c: (c = 'a')::INTEGER), 'sum')::BIGINT AS a FROM documents WHERE text <> ''")
def base_case(spark, d):
    rows = T.table(spark, d, "documents").where("text <> ''")
    hot = scalars.one_hot(F.translate(F.translate(F.substring("text", 1, 8), "A", "-"), "a", "A"))
    return rows.select("doc_id", F.md5(scalars.upper_bases(F.col("text"))).alias("upper"), F.aggregate(F.get(hot, F.lit(0)), F.lit(0).cast("bigint"), lambda x, y: x + y).alias("a"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_size = 0 THEN 0.0 ELSE round(log2((p_partkey % 7) / (0.25::DOUBLE * p_size)), 9) END AS change FROM part")
def fold_change(spark, d):
    return T.table(spark, d, "part").select("p_partkey", F.round(scalars.fold_change(F.col("p_partkey") % 7, F.lit(0.25), F.col("p_size")), 9).alias("change"))


@query("SELECT p_partkey, 'MM' || CASE WHEN p_partkey % 2 = 0 THEN ',RG' ELSE '' END AS tags FROM part")
def clear_kinetics(spark, d):
    made = F.when(F.col("p_partkey") % 2 == 0, F.create_map(*(F.lit(x) for x in ("MM", "1", "fi", "2", "RG", "3")))).otherwise(F.create_map(*(F.lit(x) for x in ("MM", "1", "rp", "2", "ri", "3"))))
    return T.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(codec.drop_tags(made))), ",").alias("tags"))


DDDA = "(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_brand, 'a', 'Y') WHEN 1 THEN replace(p_brand, 'a', 'Z') ELSE replace(p_brand, 'a', 'R') END AS seq FROM part)"


@query(f"SELECT p_partkey, replace(replace(seq, 'Y', 'T'), 'R', 'A') AS seq, CASE WHEN contains(seq, 'Y') THEN 'T-a' WHEN contains(seq, 'R') THEN 'A+a' END AS code, length(seq) - length(replace(replace(seq, 'Y', ''), 'R', '')) AS n FROM (SELECT p_partkey, replace(translate(seq, 'BCDEFGHIJKLMNOPQSTUVWX', ''), 'r', 'N') AS seq FROM {DDDA})")
def ddda_to_m6a(spark, d):
    k = F.col("p_partkey")
    seq = F.when(k % 3 == 0, F.replace("p_brand", F.lit("a"), F.lit("Y"))).when(k % 3 == 1, F.replace("p_brand", F.lit("a"), F.lit("Z"))).otherwise(F.replace("p_brand", F.lit("a"), F.lit("R")))
    seq = F.replace(F.translate(seq, "BCDEFGHIJKLMNOPQSTUVWX", ""), F.lit("r"), F.lit("N"))
    made = codec.ddda_to_m6a(seq)
    return T.table(spark, d, "part").select("p_partkey", made["seq"].alias("seq"), made["code"].alias("code"), F.coalesce(F.size(made["marks"]), F.lit(0)).cast("bigint").alias("n"))


@query("SELECT r.region_id, count(*) AS n FROM regions r JOIN (SELECT DISTINCT type, chrom, r_start, r_end, fiber_id FROM annotations WHERE type = 'nuc') a ON a.chrom = r.chrom AND a.r_start < r.\"end\" AND r.start < a.r_end GROUP BY 1")
def region_nucleosomes(spark, d):
    nucs = T.annotations(spark, d).where("type = 'nuc'").select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"), "fiber_id").distinct()
    return intervals.overlap_sums(T.regions(spark, d), as_b(nucs), ["region_id"]).select("region_id", "n")


# Contigs as mock reads

CONTIG_SEQ = "substr(repeat('ACGTTGCAAC', 4000), 1 + length(chrom)::INTEGER, length::INTEGER)"
MOCK = f", {CONTIGS}, windows AS (SELECT chrom, s AS ref_start, least(s + 3000, length) AS ref_end, length FROM (SELECT *, unnest(range(0, length, 3000)) AS s FROM contigs))"


def plain_reads(spark, d):
    known = contigs(spark, d)
    sequences = known.select("chrom", F.expr("substr(repeat('ACGTTGCAAC', 4000), 1 + char_length(chrom), int(length))").alias("seq"))
    return tags.mock_reads(tags.plain_windows(known, 3000), sequences)


@query(f"{MOCK} SELECT chrom, ref_start, ref_end, CASE WHEN ref_start > 0 THEN 2048 ELSE 0 END AS flag, (ref_end - ref_start) || '=' AS cigar, substr({CONTIG_SEQ}, (ref_start + 1)::INTEGER, (ref_end - ref_start)::INTEGER) AS seq FROM windows")
def mock_reads(spark, d):
    return plain_reads(spark, d)


@query(f"{MOCK} SELECT region_id, ref_start, start - ref_start AS fwd_start, \"end\" - start AS length FROM regions r JOIN windows w ON r.chrom = w.chrom AND ref_start <= start AND \"end\" <= ref_end")
def mock_read_items(spark, d):
    return tags.on_mock_reads(plain_reads(spark, d), T.regions(spark, d)).select("region_id", "ref_start", "fwd_start", "length")


# Calls from kinetics


def _ip_sum(at: str, step: int) -> str:
    return " + ".join(f"(({at} + {k}) * {step} + doc_id) % 256" for k in range(-7, 8))


@query(f"""SELECT doc_id AS fiber_id, code, i::INTEGER AS pos, ml::INTEGER AS ml FROM (SELECT doc_id, i, code, CASE WHEN x <= 512 THEN 0 WHEN x <= 1536 THEN 100 WHEN x <= 2560 THEN 200 WHEN x <= 3584 THEN 250 ELSE 255 END AS ml FROM (
SELECT doc_id, i, CASE base WHEN 'T' THEN 'T-a' ELSE 'A+a' END AS code, CASE base WHEN 'T' THEN {_ip_sum('i', 7)} ELSE {_ip_sum('(n - 1 - i)', 11)} END AS x
FROM (SELECT doc_id, n, i, substr(seq, (i + 1)::BIGINT, 1) AS base FROM (SELECT doc_id, seq, length(seq) AS n, unnest(range(7, length(seq) - 7)) AS i FROM {SEQ})) WHERE base IN ('A', 'T'))) WHERE ml >= 230""")
def predict_m6a(spark, d):
    """Kinetics by formula; the mean pulse distance of a window stands for a network's score."""
    rows = mm_rows(spark, d).where("seq <> ''").select(F.col("doc_id").alias("fiber_id"), F.lit(0).alias("flag"), "seq")
    at = F.sequence(F.lit(0).cast("bigint"), F.char_length("seq").cast("bigint") - 1)
    made = lambda step: F.transform(at, lambda i: ((i * step + F.col("fiber_id")) % 256).cast("smallint"))
    reads = rows.select("*", *(made(step).alias(n) for n, step in (("fi", 7), ("fp", 3), ("ri", 11), ("rp", 5))))
    table = [(0.0, 0), (0.25, 100), (0.5, 200), (0.75, 250), (1.0, 255)]
    return kinetics.predict(reads, lambda w: (w[:, 4].sum(axis=1) * 255).round() / 4096, table, 230)
