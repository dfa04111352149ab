"""Unit vectors and properties of callers, coordinates, intervals, codecs, peaks and readers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import codec, coords, scalars
from spanforge.operators import calls, filters, intervals, kinetics, peaks, stats, tags, views
from spanforge.plans import catalogue
from spanforge.plans import more  # noqa: F401
from spanforge.sources import readers
from spanforge.streaming import incremental

# Marks and the nucleosomes they give.
NUCLEOSOMES = [
    ([100], [(0, 100)]),
    ([74], []),
    ([0, 86], [(1, 85)]),
    ([0, 74], []),
    ([0, 26, 105], [(1, 104)]),
    ([0, 86, 96, 100, 126, 210, 211, 212, 213, 214, 305, 340], [(1, 85), (101, 109), (215, 125)]),
    ([5, 40, 101], [(0, 101)]),
    ([], []),
]


@pytest.mark.parametrize("marks, want", NUCLEOSOMES)
def test_greedy(marks, want):
    assert calls.greedy(marks) == want


def test_patches():
    assert calls.patches([(1, 85)], [0, 86, 120]) == [(86, 35)]
    assert calls.patches([(20, 80)], [10, 19, 100, 120]) == [(10, 10), (100, 21)]
    assert calls.patches([], []) == []


def test_acf_and_bins():
    assert [round(x, 2) for x in stats.acf([1, 1.2, 1.4, 1.6], 2)] == [1.0, 0.25, -0.3]
    assert stats.bins_around(50, 5, 20, 200) == [(0, 20), (20, 40), (40, 60), (60, 80), (80, 100)]
    assert len(stats.feature_names()) == 41


def test_lift(spark):
    df = spark.createDataFrame([("2M2I2M3D4M",)], "c string").select(coords.cigar_blocks(F.col("c"), F.lit(100)).alias("b"))
    got = df.selectExpr("transform(b, x -> array(x.q_start, x.q_end, x.r_start))").first()[0]
    assert got == [[0, 2, 100], [4, 6, 102], [6, 10, 107]]
    boundary = spark.sql("SELECT array(named_struct('q_start', 0L, 'q_end', 11L, 'r_start', 0L), named_struct('q_start', 11L, 'q_end', 16L, 'r_start', 18L)) AS b")
    assert tuple(boundary.select(coords.lift_range(F.col("b"), F.lit(4), F.lit(11)).alias("x")).first().x) == (4, 11)
    assert boundary.select(coords.lift_range(F.col("b"), F.lit(20), F.lit(25)).alias("x")).first().x is None


def test_overlap_join_is_a_nested_loop(spark):
    r = random.Random(3)
    a = [(f"c{r.randrange(2)}", s := r.randrange(3000), s + r.randrange(1, 400), i) for i in range(200)]
    b = [(f"c{r.randrange(2)}", s := r.randrange(3000), s + r.randrange(1, 400), i) for i in range(200)]
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    left, right = spark.createDataFrame(a, "chrom string, start bigint, end bigint, i int"), spark.createDataFrame(b, "b_chrom string, b_start bigint, b_end bigint, j int")
    for tile in (64, 500, 5000):
        assert sorted((x.i, x.j) for x in intervals.overlap_join(left, right, tile).select("i", "j").collect()) == want


def test_interval_algebra_by_bases(spark):
    r = random.Random(4)
    make = lambda: [("c", s := r.randrange(900), s + r.randrange(1, 60)) for _ in range(30)]
    a, b = make(), make()
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, start bigint, end bigint")
    bases = lambda rows: {p for x in rows for p in range(x[1], x[2])}
    for window in (100, 1_000_000):
        merged, less = intervals.merge(frame(a), 0, window).select("chrom", "start", "end").collect(), intervals.subtract(frame(a), frame(b), window).select("chrom", "start", "end").collect()
        assert bases(merged) == bases(a) and bases(less) == bases(a) - bases(b)
        ends = sorted((x[1], x[2]) for x in merged)
        assert all(p[1] < q[0] for p, q in zip(ends, ends[1:]))


def test_expression():
    assert filters.parse_expression("len(nuc) < 150, qual(5mC)=10:20") == [("len", "nuc", "<", 150.0, None), ("qual", "cpg", "=", 10.0, 20.0)]
    for bad in ("len(nuc)", "size(nuc)>1", "len(msp)>1:3", "len(xyz)>2"):
        with pytest.raises(ValueError):
            filters.parse_expression(bad)


def test_mm_round_trip():
    seq = "ACGTAACCGGTTAACA"
    marks = [("A", "+", "a", 4, 200), ("A", "+", "a", 12, 7), ("T", "-", "a", 10, 9), ("C", "+", "m", 1, 255)]
    text, ml = codec.emit_mm_text(marks, seq)
    assert text == "A+a,1,1;C+m,0;T-a,1;"
    assert codec.parse_mm_text(text, ml, seq) == sorted((c, s, p, q) for _, s, c, p, q in marks)
    assert codec.parse_mm_text("C+mh,0;", [5], "AC") == [("h", "+", 1, 0), ("m", "+", 1, 5)]
    assert codec.parse_mm_text("N+n,2;", [1], "ACG") == [("n", "+", 2, 1)]


def test_ma_needs_qualities(spark):
    df = spark.createDataFrame([(1, "1000;msp+P:101-50,201-60", [40])], "fiber_id int, ma string, aq array<int>")
    with pytest.raises(Exception, match="too few"):
        codec.parse_ma(df).collect()


def test_scalars(spark):
    row = spark.createDataFrame([("ACGTn", "HG1#2#chr1", "a#b", "x,%")], "s string, c string, d string, n string")
    got = row.select(scalars.revcomp(F.col("s")), scalars.strip_prefix(F.col("c")), scalars.strip_prefix(F.col("d")), scalars.percent_decode(scalars.percent_encode(F.col("n"))), scalars.kinetics_to_u8(F.lit(191)), scalars.kinetics_to_u8(F.lit(445))).first()
    assert tuple(got) == ("nACGT", "chr1", "", "x,%", 127, 191)
    scalars.register(spark)
    assert spark.sql("SELECT reciprocal_overlap(0L, 100L, 50L, 150L), hp(1), hp(NULL), revcomp('AC')").first()[:] == (0.5, "H1", "UNK", "GT")


def test_peak_merge():
    peak = lambda s, e, score, ids: {"chrom": "c", "start": s, "end": e, "pos": (s + e) // 2, "score": score, "fdr": 0.0, "elements": set(ids), "spans": {i: (s, e) for i in ids}}
    out = peaks.merge_once([peak(0, 100, 1.0, "ab"), peak(2, 102, 3.0, "bc"), peak(400, 500, 1.0, "z")], None, 0.75)
    assert [(p["start"], p["end"], p["score"]) for p in out] == [(2, 102, 3.0), (400, 500, 1.0)]
    assert len(peaks.merge_once([peak(0, 10, 1.0, "ab"), peak(50, 60, 1.0, "ab")], 0.5, None)) == 1


def test_fdr_lookup_is_a_floor(spark):
    table = spark.createDataFrame([(1.0, 0.5), (2.0, 0.2)], "threshold double, fdr double")
    got = peaks.lookup_fdr(spark.createDataFrame([(0.5,), (1.0,), (1.9,), (9.0,)], "score double"), table).orderBy("score").collect()
    assert [r.fdr for r in got] == [0.5, 0.5, 0.5, 0.2]
    assert peaks.lookup_fdr(spark.createDataFrame([(0.5,)], "score double"), table.where("fdr > 1")).first().fdr == 1.0


def test_readers(spark, tmp_path):
    assert readers.region("chr1:1,000-2,000") == ("chr1", 1000, 2000) and readers.region("chr2") == ("chr2", None, None)
    assert readers.modules("modules: [[0,1],[1,9]]") == [(0, 1), (1, 9)]
    with pytest.raises(ValueError):
        readers.modules("modules: [[0,1],[2,9]]")
    bed = tmp_path / "a.bed"
    bed.write_text("#c\nchr1\t5\t9\tx\t0\t-\n\nchr1\t1\t3\n")
    assert [(r.chrom, r.start, r.end, r.name) for r in readers.bed(spark, str(bed)).orderBy("start").collect()] == [("chr1", 1, 3, None), ("chr1", 5, 9, "x")]
    assert sorted((r.pos, r.strand) for r in readers.centers(spark, str(bed)).collect()) == [(1, "+"), (8, "-")]
    fa = tmp_path / "a.fa"
    fa.write_text(">c1 x\nACG\nT\n>c2\nGG\n")
    assert sorted((r.name, r.seq) for r in readers.fasta(spark, str(fa)).collect()) == [("c1", "ACGT"), ("c2", "GG")]
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1\nr1\t16\tchr1\t11\t60\t4M\t*\t0\t0\tACGT\t!!!!\tHP:i:2\tec:f:3.5\n")
    row = readers.sam(spark, str(sam)).first()
    assert (row.fiber_id, row.ref_start, row.strand, row.hp, row.rg, row.ec) == ("r1", 10, "-", "H2", ".", 3.5)
    table = spark.createDataFrame([(0.5, 0.1, 10.0, 100.0)], "threshold double, fdr double, shuffled_bp double, real_bp double")
    readers.write_fdr_table(table, str(tmp_path / "fdr"))
    assert tuple(readers.fdr_table(spark, str(tmp_path / "fdr")).first()) == (0.5, 0.1, 10.0, 100.0)


def test_trees(spark):
    trees = [{"nodeid": 0, "split": "x", "split_condition": 1.0, "yes": 1, "no": 2, "missing": 1, "children": [{"nodeid": 1, "leaf": -2.0}, {"nodeid": 2, "leaf": 2.0}]}]
    got = stats.tree_scores(spark.createDataFrame([(0.5,), (1.5,)], "x double"), ["x"], trees).orderBy("x").collect()
    assert got[0].score < 0.2 and got[1].score > 0.8


def test_streaming_is_additive(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).selectExpr("id % 3 AS v").write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("v bigint").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    incremental.additive(stream, lambda b: b.groupBy("v").count(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {r.v: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("v").agg(F.sum("count").alias("n")).collect()}
    assert got == {0: 7, 1: 7, 2: 6}


def test_fire_features_cover_every_fiber(spark):
    import collections
    import re

    from spanforge.plans import catalogue
    from spanforge.sources import tables as T

    sf = "/root/testdata/sf0.001"
    code = str.maketrans("BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    docs = {r.doc_id: re.sub("[^a-zA-Z]", "", r.text or "").upper().translate(code) or "ACGT" for r in T.table(spark, sf, "documents").collect()}
    rows = T.annotations(spark, sf).collect()
    marks, want = collections.defaultdict(set), collections.Counter()
    for r in rows:
        if r.type == "m6a":
            marks[r.fiber_id].add(r.q_start)
    for r in rows:
        if r.type == "msp" and r.length >= 85:
            letters = docs[r.fiber_id % len(docs)]
            seq = (letters * (r.read_length // len(letters) + 1))[: r.read_length]
            m6a = {m for m in marks[r.fiber_id] if 0 <= m < r.read_length}
            end = min(r.q_end, r.read_length)
            want[r.fiber_id, r.q_start, r.read_length, len(m6a), sum(c in "AT" for c in seq), sum(r.q_start <= m < end for m in m6a)] += 1
    names = ["fiber_id", "msp_start", "read_length", "fiber_m6a_count", "fiber_at_count", "msp_m6a_count"]
    assert collections.Counter(tuple(map(int, r)) for r in catalogue.QUERIES["fire_features"](spark, sf).select(*names).collect()) == want


def test_acf_lags_go_to_250(spark):
    from spanforge.plans import catalogue
    from spanforge.sources import tables as T

    sf, at, off = "/root/testdata/sf0.001", set(), {}
    n = 0
    for f in sorted(T.fibers(spark, sf).collect(), key=lambda r: r.fiber_id):
        off[f.fiber_id] = n
        n += f.read_length
    at = {off[r.fiber_id] + r.fwd_start for r in T.marks(spark, sf).where("type = 'm6a'").collect() if r.fiber_id in off}
    k = len(at)
    m, got = k / n, {r.lag: r.acf for r in catalogue.QUERIES["acf_lags"](spark, sf).collect()}
    assert sorted(got) == list(range(251))
    for lag, acf in got.items():
        ends = sum(p < lag for p in at) + sum(p >= n - lag for p in at)
        want = (sum(p + lag in at for p in at) - m * (2 * k - ends) + m * m * (n - lag)) / (k - m * k)
        assert abs(acf - want) < 1e-8


def test_one_hot(spark):
    row = spark.sql("SELECT 'AGTCA' AS s").select(scalars.one_hot(F.col("s")).alias("h")).first()
    assert row.h == [[1, 0, 0, 0, 1], [0, 0, 0, 1, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0]]


def test_overlap_sums_are_a_nested_loop(spark):
    r = random.Random(9)
    made = lambda n: [(i, r.choice(["x", "y"]), s := r.randrange(300), s + r.randrange(0, 60)) for i in range(n)]
    a, b = made(80), made(120)
    left = spark.createDataFrame(a, "id int, chrom string, start bigint, end bigint")
    right = spark.createDataFrame([x[1:] for x in b], "b_chrom string, b_start bigint, b_end bigint")
    want = {}
    for i, c, s, e in a:
        both = [min(e, f) - max(s, t) for _, d, t, f in b if c == d and t < f and s < e and t < e and s < f]
        if both:
            want[i] = (len(both), sum(both))
    for tile in (7, 64, 5000):
        assert {x.id: (x.n, x.bp) for x in intervals.overlap_sums(left, right, ["id"], tile).collect()} == want
    assert intervals.overlap_sums(left, right.limit(0), ["id"]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_self_semi_is_a_nested_loop(spark):
    """Against all pairs; and no row is joined to rows, only to places."""
    r = random.Random(17)
    for n, span, length in ((150, 4000, 60), (200, 1500, 400), (60, 9000, 2500), (1, 10, 5)):
        rows = [(f"c{r.randrange(2)}", s := r.randrange(span), s + r.randrange(1, length), i) for i in range(n)]
        df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, i int")
        for f in (0.05, 0.25, 0.9, 1.0):
            want = sorted(x[3] for x in rows if any(y[3] != x[3] and y[0] == x[0] and min(x[2], y[2]) - max(x[1], y[1]) >= f * (x[2] - x[1]) for y in rows))
            for tile in (32, 5000):
                assert sorted(x.i for x in intervals.overlap_self_semi(df, f, tile).collect()) == want
    # a hundred thousand rows at few places: 5e9 pairs
    many = spark.range(100_000).select(F.lit("c").alias("chrom"), (F.col("id") % 50).alias("start"), (F.col("id") % 50 + 60 + F.col("id") % 7).alias("end"), "id")
    assert intervals.overlap_self_semi(many, 0.25).count() == 100_000


def test_pairs_are_the_same_broadcast_or_shuffled(spark, monkeypatch):
    """Few points are broadcast and no pair is shuffled; many are not broadcast; the rows are the same."""
    sf = "/root/testdata/sf0.001"
    names = ["center_long", "center_long_dist", "center_spans", "center_sequence", "center_wide", "center_wide_cpg", "join_center_point", "join_motif_span", "footprint_codes", "footprint_long", "footprint_lists"]
    small = {n: catalogue.QUERIES[n](spark, sf) for n in names}
    assert all("SortMergeJoin" not in plan_of(small[n]).split("BroadcastHashJoin")[0] for n in names)
    grouped = ["footprint_lists"]
    assert all("Exchange hash" not in plan_of(small[n]).split("BroadcastHashJoin")[0] for n in names if n not in grouped)
    monkeypatch.setattr(intervals, "SMALL", 0)
    for n in names:
        large = catalogue.QUERIES[n](spark, sf)
        assert small[n].count() == large.count() and small[n].exceptAll(large).isEmpty()


def test_footprint_sums_are_counts_of_codes(spark):
    """Motifs of several lengths on both strands, fibers with and without elements, against the pairs."""
    r = random.Random(29)
    fibers = [(i, f"c{r.randrange(2)}", s := r.randrange(400), s + r.randrange(20, 300)) for i in range(60)]
    marks = [(f[0], f[1], f[2], f[3], r.choice(["msp", "nuc", "m6a", "cpg"]), r.choice([100, 240, None]), s := r.randrange(f[2], f[3]), s + r.randrange(1, 90)) for f in fibers[:50] for _ in range(r.randrange(9))]
    motifs = [(f"c{r.randrange(2)}", s := r.randrange(600), s + r.choice([5, 20, 35]), r.choice("+-"), k) for k in range(80)]
    f = spark.createDataFrame(fibers, "fiber_id int, chrom string, ref_start bigint, ref_end bigint")
    a = spark.createDataFrame(marks, "fiber_id int, chrom string, ref_start bigint, ref_end bigint, type string, qual int, r_start bigint, r_end bigint")
    m = spark.createDataFrame(motifs, "chrom string, start bigint, end bigint, strand string, motif_id int")
    modules = [(0, 8), (8, 16), (16, 35)]
    codes = {(x.motif_id, x.fiber_id): (x.has_msp, x.has_fire, x.has_nuc, x.code) for x in views.footprint_codes(m, a, modules, fibers=f).collect()}
    want = {}
    for chrom, s, e, strand, k in motifs:
        for i, c, lo, hi in fibers:
            if c == chrom and s > lo and e < hi:
                own = [x[4:] for x in marks if x[0] == i]
                spans = [x for x in own if x[0] == "msp" and x[2] < s and x[3] > e]
                places = [e - x[2] - 1 if strand == "-" else x[2] - s for x in own if x[0] == "m6a"]
                code = bool(spans) + sum(2 << j for j, (p, q) in enumerate(modules) if not any(p <= x < q for x in places))
                want[k, i] = (bool(spans), any((x[1] or 0) >= 229 for x in spans), any(x[0] == "nuc" and x[2] < e and x[3] > s for x in own), code)
    assert codes == want and len(want) > 300
    counts = views.footprint_counts(views.footprint_codes(m, a, modules, fibers=f), modules)
    sums = views.footprint_sums(m, a, modules, 50, fibers=f).select(counts.columns)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, counts.collect()))


def test_fdr_table_by_rows(spark):
    """Against the rows one by one: cumulative from above, then the last of rows alike, four times."""
    r = random.Random(12)
    scores = [(round(r.random() * 9, r.choice([1, 2, 6])), r.randrange(1, 40), r.random() < 0.6) for _ in range(500)]
    by = {}
    for s, bp, real in scores:
        v, k = by.get(s, (0, 0))
        by[s] = (v + (0 if real else bp), k + (bp if real else 0))
    rows, v, k = [], 0, 0
    for s in sorted(by, reverse=True):
        v, k = v + by[s][0], k + by[s][1]
        if s > min(by) and k:
            rows.append((s, min(1.0, v / k), float(v), float(k)))
    rows.append((-1.0, 1.0, 1.0, 1.0))
    for key, alike in ((1, lambda x: int(x[1] * 1e6)), (2, lambda x: int(x[2])), (3, lambda x: int(x[3])), (0, lambda x: int(x[0] * 100))):
        rows = [(round(x[0], 2), *x[1:]) if key == 0 else x for x in rows]
        rows = sorted(rows, key=lambda x: x[key])
        rows = list({alike(x): x for x in rows}.values())
    got = peaks.fdr_table(spark.createDataFrame(scores, "score double, bp bigint, is_real boolean")).collect()
    assert sorted((x.threshold, x.fdr, x.shuffled_bp, x.real_bp) for x in got) == sorted(rows)


def test_mock_windows_cut_no_item(spark):
    items = spark.createDataFrame([("a", 5, 40), ("a", 95, 130), ("a", 300, 310), ("b", 1, 2)], "chrom string, start bigint, end bigint")
    contigs = spark.createDataFrame([("a", 1000), ("b", 50), ("c", 70)], "chrom string, length bigint")
    got = sorted(tuple(x) for x in tags.mock_windows(items, contigs, 100).collect())
    assert got == [("a", 0, 130), ("a", 300, 400), ("b", 0, 50), ("c", 0, 70)]


def test_peaks_of_planted_sites(spark):
    """Tracks with fires stacked at sites pass the FDR limit of 0.05 there alone, and near sites merge."""
    from spanforge.operators.pileup import PileupOptions, pileup, rolling_max

    r = random.Random(3)
    sites, fibers, marks, moved = [2000, 5000, 5060, 8000], [], [], []
    for i in range(60):
        fibers.append((i, "c", 0, 10000, "UNK"))
        for s in sites:
            if r.random() < 0.8:
                a = s + r.randrange(-10, 10)
                marks.append((i, "c", "msp", 250, a, a + 80, "UNK"))
        for _ in range(4):
            a = r.randrange(9900)
            moved.append((i, "c", "msp", 250, a, a + 80, "UNK"))
    f = spark.createDataFrame(fibers, "fiber_id bigint, chrom string, ref_start bigint, ref_end bigint, hp string")
    kind = "fiber_id bigint, chrom string, type string, qual int, r_start bigint, r_end bigint, hp string"
    options = PileupOptions(no_nuc=True, no_msp=True)
    real, fake = (pileup(f, spark.createDataFrame(m, kind), options) for m in (marks, moved))
    table = peaks.fdr_table(peaks.histogram(real, True).unionByName(peaks.histogram(fake, False)))
    found = peaks.significant(peaks.lookup_fdr(peaks.islands(rolling_max(real)), table))
    e = spark.createDataFrame(marks, kind).select("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end"), "fiber_id").withColumn("element", F.xxhash64("fiber_id", "start"))
    bounded = peaks.bounds(found, e)
    rows = bounded.collect()
    assert rows and all(x.fdr <= 0.05 and any(s - 20 <= x.pos <= s + 100 for s in sites) for x in rows)
    assert all(any(abs(x.pos - s - 40) < 40 for x in rows) for s in (2000, 8000))
    at = bounded.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("pos").alias("p"))
    own = intervals.overlap_join(at, e.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "element"))
    own = own.groupBy("chrom", F.col("p").alias("pos")).agg(F.collect_set(F.struct(F.col("element").alias("id"), F.col("b_start").alias("start"), F.col("b_end").alias("end"))).alias("elements"))
    full = bounded.join(own, ["chrom", "pos"]).select("chrom", F.col("peak_start").alias("start"), F.col("peak_end").alias("end"), "pos", "score", "fdr", "elements")
    merged = peaks.merge_peaks(full).collect()
    assert 3 <= len(merged) < len(rows) or len(rows) == 3
    assert {min(sites, key=lambda s: abs(x.pos - s - 40)) for x in merged} >= {2000, 8000}


def test_kinetics_windows_base_by_base():
    r = random.Random(5)
    seq = "".join(r.choice("ACGT") for _ in range(60))
    n, other = len(seq), {"A": "T", "C": "G", "G": "C", "T": "A"}
    fi, fp, ri, rp = ([r.randrange(256) for _ in range(n)] for _ in range(4))
    made = kinetics.strands(seq, *(np.array(x) for x in (fi, fp, ri, rp)))
    for code, base in (("T-a", "T"), ("A+a", "A")):
        places, layers = made[code]
        assert list(places) == [i for i, c in enumerate(seq) if c == base]
        got = kinetics.windows(layers, places if code == "T-a" else n - 1 - places)
        for p, w in zip(places, got):
            for k in range(15):
                # the window of A runs backwards on the other strand
                at = p - 7 + k if code == "T-a" else p + 7 - k
                if p < 7 or p + 8 > n:
                    assert not w[:, k].any()
                    continue
                letter = seq[at] if code == "T-a" else other[seq[at]]
                ip, pw = (fi[at], fp[at]) if code == "T-a" else (ri[n - 1 - at], rp[n - 1 - at])
                assert list(w[:4, k]) == [float(letter == b) for b in "ACGT"]
                assert np.allclose(w[4:, k], [ip / 255, pw / 255])


def test_predict_skips_and_flips(spark):
    seq, ones = "CCCCCCCCTCCCCCCCCC", [255] * 18
    kinds = "fiber_id bigint, flag int, seq string, fi array<int>, fp array<int>, ri array<int>, rp array<int>"
    back = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = [(1, 0, seq, ones, ones, ones, ones), (2, 256, seq, ones, ones, ones, ones), (3, 0, seq, None, ones, ones, ones), (4, 16, back, ones, ones, ones, ones), (5, 0, None, ones, ones, ones, ones), (6, 0, "T", [1], [1], [1], [1])]
    mean = lambda w: w[:, 4].mean(axis=1)
    got = kinetics.predict(spark.createDataFrame(rows, kinds), mean, [(0.0, 0), (1.0, 255)], 100)
    assert sorted(tuple(x) for x in got.collect()) == [(1, "T-a", 8, 255), (4, "T-a", 8, 255)]
    assert got.where("fiber_id < 0").count() == 0
    assert list(kinetics.nearest_ml(np.array([-1.0, 0.25, 0.5, 0.51, 2.0]), [(0.0, 1), (1.0, 9)])) == [1, 1, 1, 9, 9]
    with pytest.raises(ValueError):
        kinetics.strands("ACGT", *(np.zeros(3),) * 4)


def test_mock_reads_hold_their_items(spark):
    contigs = spark.createDataFrame([("a", 25), ("b", 4), ("e", 0)], "chrom string, length bigint")
    seqs = spark.createDataFrame([("a", "ACGTACGTACGTACGTACGTACGTA"), ("b", "GGCC")], "chrom string, seq string")
    reads = tags.mock_reads(tags.plain_windows(contigs, 10), seqs)
    got = sorted(tuple(x) for x in reads.collect())
    assert got == [("a", 0, 10, 0, "10=", "ACGTACGTAC"), ("a", 10, 20, 2048, "10=", "GTACGTACGT"), ("a", 20, 25, 2048, "5=", "ACGTA"), ("b", 0, 4, 0, "4=", "GGCC")]
    items = spark.createDataFrame([("a", 12, 15, "x%2Cy;z"), ("a", 8, 12, "cut"), ("b", 0, 4, "w")], "chrom string, start bigint, end bigint, name string")
    marks = tags.on_mock_reads(reads, items)
    assert sorted((r.chrom, r.ref_start, r.fwd_start, r.length) for r in marks.collect()) == [("a", 10, 2, 3), ("b", 0, 0, 4)]
    bed = sorted(tuple(x) for x in tags.bed_of_mock_reads(marks).collect())
    assert bed == [("a", 12, 15, ["x,y", "z"]), ("b", 0, 4, ["w"])]
    assert tags.mock_windows(items.where("chrom = 'x'"), contigs, 10).collect() == [("b", 0, 4), ("e", 0, 0)]


def test_peak_table_by_rows(spark):
    found = spark.createDataFrame([("c", 10, 20, 15, 0.0123456789012), ("c", 40, 50, 45, 0.5), ("d", 1, 3, 2, 0.0)], "chrom string, start bigint, end bigint, pos bigint, fdr double")
    kinds = "chrom string, start bigint, end bigint, coverage bigint, fire_coverage bigint, nuc bigint, msp bigint, score double, coverage_h1 bigint, fire_coverage_h1 bigint, nuc_h1 bigint, msp_h1 bigint, score_h1 double"
    runs = spark.createDataFrame([("c", 0, 15, 1, 1, 1, 1, 1.0, 0, 0, 0, 0, -1.0), ("c", 15, 16, 9, 5, 3, 4, 12.5, 4, 2, 1, 1, 7.25), ("c", 40, 60, 99, 8, 7, 6, 2.0, 1, 0, 0, 1, -1.0)], kinds)
    limits = spark.createDataFrame([("c", 4.0, 20.0)], "chrom string, least double, most double")
    table = peaks.as_text(peaks.peak_table(found, runs, limits))
    assert len(table.columns) == 21 and table.columns[:6] == ["chrom", "peak_start", "peak_end", "peak_max", "FDR", "coverage"]
    got = ["\t".join(r) for r in table.orderBy("chrom", "peak_start").collect()]
    none = "0\t0\t-1.00000\t0\t0"
    assert got[0] == f"c\t10\t20\t15\t0.0123456789\t9\t5\t12.50000\t3\t4\t4\t2\t7.25000\t1\t1\t{none}\ttrue"
    assert got[1].endswith(f"{none}\tfalse") and got[1].split("\t")[5] == "99"
    assert got[2] == f"d\t1\t3\t2\t0.0000000000\t{none}\t{none}\t{none}\tfalse"


def test_headers_and_shuffled_fibers(spark, tmp_path):
    sam = tmp_path / "h.sam"
    sam.write_text("@SQ\tSN:c\tLN:9\n@PG\tID:x\tPN:x\n@HD\tVN:1.6\n@PG\tID:y\tPN:y\tPP:x\nr1\t0\n")
    headers = readers.sam_header(spark, str(sam))
    assert [r.value for r in readers.header_text(headers).collect()] == ["@HD\tVN:1.6", "@PG\tID:x\tPN:x", "@PG\tID:y\tPN:y\tPP:x", "@SQ\tSN:c\tLN:9"]
    once = tags.with_provenance(headers, "y", "1", "y run")
    assert [r.line for r in once.where("line like '%CL:%'").collect()] == ["ID:y.1\tPN:y\tVN:1\tPP:y\tCL:y run"]
    first = tags.with_provenance(headers.where("type = 'SQ'"), "y", "1", "y run")
    assert [r.line for r in first.where("type = 'PG'").collect()] == ["ID:y\tPN:y\tVN:1\tCL:y run"]
    bed = tmp_path / "s.bed"
    bed.write_text("#chrom\tstart\nc\t100\t110\tf1\t5\nc\t7\t9\tf2\t70\n")
    places = readers.shuffled_fibers(spark, str(bed))
    fibers = spark.createDataFrame([("c", "f1", 5, 15), ("c", "f2", 71, 73)], "chrom string, fiber_id string, ref_start bigint, ref_end bigint")
    from spanforge.operators.pileup import shuffled

    assert [(r.fiber_id, r.ref_start, r.ref_end) for r in shuffled(fibers, places).collect()] == [("f1", 100, 110)]
