"""The training-data operators against brute force, exact round trips and held-out accuracy; odd inputs."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import bpe_count, components, decontaminate, jpeg, langid, line_dedup, media, mixing, ngram_join, quality, secret_scan, wrapper

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "the and of " * 9000, "en", None, 9), (3, "漢字😀\n\x00\t%|", None, "b", 3), (None, "the and of it\nthe and of it", "en", "a", 1), (None, "the and of it\nthe and of it", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("all", "id", "row", "of", "places", "ld_id", "gone_id", "bad_id", "bad_row", "dc_id", "nj_id", "nj_row", "again_id", "page", "held_out", "score", "blob"):
        df = df.withColumn(name, F.lit(name))
    return df.withColumn("size", F.lit("x")).withColumn("copies", F.lit(2)).withColumn("class", F.lit(3)).withColumn("line", F.lit(4)).withColumn("n_dropped", F.lit(5))


def union_find(pairs, ids):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    ids = [r.getrandbits(62) for _ in range(300)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(200)] + list(zip(ids[:80], ids[1:80]))
    want = union_find(pairs, ids)
    got = {x.id: x.root for x in components.components(spark.createDataFrame([*pairs, (None, ids[0]), (5, 5)], "u bigint, v bigint")).collect()}
    groups = collections.defaultdict(set)
    for i, root in got.items():
        groups[root].add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want[i] for i in got})
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_language_id(docs, odd):
    out = langid.predict(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 40 and sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)
    got = langid.predict(odd, langid.learn(docs)).collect()
    assert len(got) == 7 and sum(r.lang_pred == "und" for r in got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(odd.limit(0), langid.learn(odd.limit(0))).count() == 0


def test_automaton_and_phrases():
    moves = langid.suffix_automaton([1, 2, 1, 3])
    walk = lambda s: all((state := moves[state].get(c)) is not None for c in s) if (state := 0) == 0 else None
    assert walk([2, 1, 3]) and walk([1, 2, 1, 3]) and not walk([3, 1])
    parser = langid.CrossParser({"a": [b"abcabcabd"], "b": [b"xyzzyx"]})
    text = b"abcabd"
    rate = parser.rates(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert round(rate[0] * len(text) / parser.bits[0]) == 1 and round(rate[1] * len(text) / parser.bits[1]) == 7
    whole = parser.rates(np.frombuffer(text + text, np.uint8), np.array([0, 6, 6, 12]))
    assert np.allclose(whole[0], rate) and np.allclose(whole[2], rate) and whole[1].tolist() == [0, 0]


def test_mixing(docs, odd):
    out = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.source] += r.size
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
    cap, weight = {s: 2.0 * n for s, n in sizes.items()}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, left, active = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while active:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] >= cap[s]}
        for s in over or active:
            target[s] = cap[s] if over else share[s]
        left -= sum(target[s] for s in over)
        active = active - over if over else set()
    assert all(abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) for r in out)
    key = lambda rows: sorted(map(str, rows))
    assert key(out) == key(mixing.mix(docs.repartition(7)).collect())
    got = mixing.mix(odd).collect()
    assert len(got) == 7 and {r.source_size for r in got if r.source is None} == {27000} and mixing.mix(odd.limit(0)).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.count() == sum(r.copies for r in out) and mixing.mixed_documents(odd).columns == [*odd.columns, "copy"]


def norm(line):
    line = re.sub(r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+", "", line.lower())
    return re.sub("[1-9]", "0", re.sub(r"[ \t\x0B-\x0D]+", " ", line).strip(" "))


def distance(a, b):
    """Levenshtein distance; a column of the table is two whole numbers, a bit a row: up and down from the row before."""
    at = collections.defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    every, up, down, score = (1 << len(a)) - 1, (1 << len(a)) - 1, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        level = same | down
        flat = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(flat | up)), up & flat
        score += (more >> len(a) - 1 & 1) - (less >> len(a) - 1 & 1) if a else 1
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every & ~(level | more)), more & level
    return score


def similar(a, b):
    return distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def made_words(r, n, letters="abcdefghijklmnop"):
    return ["".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(n)]


def dropped(spark, texts):
    out = line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return {x.doc_id: (x.text, x.n_dropped) for x in out}


def test_line_dedup(spark, odd):
    r = random.Random(5)
    words = made_words(r, 400)
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [base[0] + "\nshort line", base[0] + "\n\n" + base[1] + "\n", base[2] + "\n" + base[1].upper() + "!", base[3] + "\n---\n---", "\t".join(words) + "\n" + base[4], "new\n" + " ".join(words) + " "]
    got = dropped(spark, rows)
    assert got == {0: (rows[0], 0), 1: ("\n" + base[1] + "\n", 1), 2: (base[2], 1), 3: (rows[3], 0), 4: (rows[4], 0), 5: ("new", 1)}
    out = line_dedup.dedup(odd)
    assert out.columns == [*(c for c in odd.columns if c != "n_dropped"), "n_dropped"]
    assert out.count() == 7 and line_dedup.dedup(odd.limit(0)).count() == 0 and out.where("text is null").count() == 1
    # of two equal rows one loses every line with a word
    assert sorted((x.text, x.n_dropped) for x in out.where("doc_id is null and text is not null").collect()) == [("", 2), ("the and of it", 1)]


def test_line_dedup_finds_lines_by_edit_similarity_alone(spark):
    """Recall by line length against all pairs of edit similarity 0.8, without a look at hashes; lines far from all stay."""
    r = random.Random(11)
    words, lines, kind = made_words(r, 3000), [], []
    typo = lambda w: w[: (k := r.randrange(len(w)))] + r.choice("qrstuv") + w[k + r.randrange(2) :]
    for n in (5, 6, 8, 10, 20, 30, 50, 100, 300):
        for share in (0.0, 0.1, 0.2):
            for k in range(12):
                base = [r.choice(words) for _ in range(n)]
                at = set(r.sample(range(n), max(1, round(n * share))))
                other = [(typo(w) if k % 3 == 0 else r.choice(words)) if i in at else w for i, w in enumerate(base)]
                if k % 3 == 1:  # a word gone or more
                    other.pop(r.randrange(n)) if k % 2 else other.insert(r.randrange(n), r.choice(words))
                lines += [" ".join(base), " ".join(other)]
                kind.append(n)
    true = [k for k in range(0, len(lines), 2) if similar(norm(lines[k]), norm(lines[k + 1]))]
    out = {k: n for k, (_, n) in dropped(spark, lines).items()}
    assert not any(out[k] for k in range(0, len(lines), 2)) and not any(out[k + 1] for k in range(0, len(lines), 2) if k not in true)
    found = collections.Counter(kind[k // 2] for k in true if out[k + 1])
    asked = collections.Counter(kind[k // 2] for k in true)
    assert len(true) > 200 and sum(found.values()) >= 0.95 * len(true), (found, asked)
    assert all(found[n] >= 0.85 * asked[n] for n in asked), (found, asked)


def test_line_dedup_groups_are_those_of_all_pairs(spark):
    """Lines that quote one passage, a large group of near copies, and pairs among them, against brute force."""
    r = random.Random(23)
    words = made_words(r, 4000)
    some = lambda n: [r.choice(words) for _ in range(n)]
    passage, copy = some(50), some(40)
    lines = [some(r.randrange(60)) + passage + some(r.randrange(20, 60)) for _ in range(70)]
    lines += [[w if r.random() > 0.04 else r.choice(words) for w in x] for x in lines[:25]]
    lines += [[w if r.random() > 0.03 else r.choice(words) for w in copy] for _ in range(60)]
    lines += [passage[:i] + passage[i + 1 :] for i in range(0, 50, 5)]
    r.shuffle(lines)
    texts = [" ".join(x) for x in lines]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(norm(texts[i]), norm(texts[j]))]
    want = union_find(pairs, range(len(texts)))
    units = line_dedup.materialize(line_dedup.signed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")), "t")
    line = {x.doc_id: x.line for x in units.collect()}
    root = {x.id: x.root for x in line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), units).collect()}
    got = [root.get(line[i], line[i]) for i in range(len(texts))]
    assert all(len({want[i] for i in range(len(texts)) if got[i] == g}) == 1 for g in set(got))  # nothing unlike together
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs)


def test_line_dedup_compares_all_lines_of_a_large_bucket(spark):
    """Many lines quote a passage; pairs of them are alike, but share no run of words beside it."""
    r = random.Random(41)
    words = made_words(r, 6000)
    some = lambda n: [r.choice(words) for _ in range(n)]
    passage, texts = some(60), []
    for _ in range(14):
        rest = some(30)
        texts += [" ".join(passage + rest), " ".join(passage + [r.choice(words) if i % 3 == 0 else w for i, w in enumerate(rest)])]
    texts += [" ".join(passage + some(30)) for _ in range(30)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(norm(texts[i]), norm(texts[j]))]
    assert pairs == [(k + 1, k) for k in range(0, 28, 2)]
    got = dropped(spark, texts)
    assert [k for k in got if got[k][1]] == [i for i, _ in pairs]


def test_line_dedup_writes_no_pairs_of_a_large_bucket(spark, monkeypatch):
    """Of lines that quote one passage and are unlike, only a few rows a line are written, and the few links are found."""
    r = random.Random(43)
    words = made_words(r, 6000)
    some = lambda n: [r.choice(words) for _ in range(n)]
    passage, texts, written = some(60), [], []
    for _ in range(120):
        rest = some(30)
        texts += [" ".join(passage + rest)]
    texts += [" ".join(passage + [r.choice(words) if i % 3 == 0 else w for i, w in enumerate(x.split()[60:])]) for x in texts[:5]]
    plain = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])
    monkeypatch.setattr(line_dedup, "discard", lambda *frames: None)
    got = dropped(spark, texts)
    assert [k for k in got if got[k][1]] == [k for k in range(120, 125) if similar(norm(texts[k]), norm(texts[k - 120]))] != []
    rows = {name: df.count() for name, df in written}
    assert max(rows.values()) <= 12 * len(texts), rows


def test_line_dedup_deals_out_a_large_bucket_by_length(spark, monkeypatch):
    """The lines of one bucket meet by length class, also across the border of two; bits bound what one bag alone has."""
    r = random.Random(47)
    words = made_words(r, 3000)
    x = [r.choice(words) for _ in range(400)]
    texts = [" ".join(x[: n + 12 * n // 100]) for n in range(20, 320, 9)]
    lines = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "line bigint, norm string, simhash bigint")
    crowded = lines.select(F.lit(7).cast("bigint").alias("key"), "line", F.char_length("norm").alias("chars"))
    plain, plans = line_dedup.materialize, {}
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}) or plain(df, name))
    none = spark.createDataFrame([], "id bigint, root bigint")
    got = line_dedup.links_apart(crowded, none, lines.select("line", "norm"), lines.select("line", "simhash"), 0.8).collect()
    want = {(i, j) for j in range(len(texts)) for i in range(j) if similar(texts[i], texts[j])}
    assert len(got) == len(want) and {(min(p), max(p)) for p in got} == want != set()
    assert "wide_a" in next(x for x in plans["ld-apart"].splitlines() if "Join" in x)
    bags = lines.select("line", line_dedup.bag(F.col("norm")).alias("bag")).select("line", F.array_sort("bag").alias("bag"), *line_dedup.bag_bits()).collect()
    for a, b in zip(bags, bags[::-1]):
        alone = sum(bin(a[f"s{j}"] & ~b[f"s{j}"] & (1 << 64) - 1).count("1") for j in range(line_dedup.SIGNED))
        assert alone <= len(set(a.bag) - set(b.bag)) and (alone > 0) == (len(a.bag) > len(b.bag))


def test_bags_hold_equal_words_as_often(spark):
    r = random.Random(2)
    words = made_words(r, 30)
    lines = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(zip(lines[::2], lines[1::2], strict=True)), "x string, y string")
    got = rows.select("x", "y", F.size(F.array_intersect(line_dedup.bag(F.col("x")), line_dedup.bag(F.col("y")))).alias("n")).collect()
    assert all(p.n == sum((collections.Counter(p.x.split()) & collections.Counter(p.y.split())).values()) for p in got)
    assert spark.createDataFrame([(" ".join(words * 200),)], "x string").select(line_dedup.bag(F.col("x"))).first()[0] is None


def test_edits_of_pieces_bound_those_of_lines(spark):
    r = random.Random(1)
    words, rows = made_words(r, 300), []
    for _ in range(200):
        x = [r.choice(words) for _ in range(r.randrange(32, 120))]
        y = list(x)
        for _ in range(r.randrange(len(x) // 3)):
            k = r.randrange(len(y))
            y[k : k + r.choice([0, 1, 1, 9])] = [r.choice(words)] * r.randrange(3)
        rows.append((" ".join(x), " ".join(y)))
    df = spark.createDataFrame(rows, "x string, y string").select("*", *(line_dedup.word_code(F.col(t)).alias(f"c{t}") for t in "xy"), *(F.split(t, " ").alias(f"w{t}") for t in "xy"))
    assert all(p.bound >= distance(p.x, p.y) for p in df.select("x", "y", F.expr(line_dedup.piecewise()).alias("bound")).collect())
    got = {(p.x, p.y) for p in line_dedup.alike(df.drop("wx", "wy"), 0.8).collect()}
    assert got == {p for p in rows if similar(*p)} and 40 < len(got) < 160


def test_line_dedup_without_blanks(spark):
    r = random.Random(3)
    line = "".join(chr(r.randrange(0x4E00, 0x5200)) for _ in range(80))
    got = dropped(spark, [line, line[:30] + "\u5300" + line[31:], line[::-1], line[:9], line[:4] + "\u5300" + line[5:9]])
    assert [got[k][1] for k in range(5)] == [0, 1, 0, 0, 1]


def test_simhash_is_the_majority_of_bits(spark):
    r = random.Random(3)
    words = made_words(r, 500)
    lines = [" ".join(r.choice(words) for _ in range(n)) for n in (2, 3, 8, 100, 301)]
    got = {x.line: x.simhash for x in line_dedup.simhashes(spark.createDataFrame(list(enumerate(lines)), "line bigint, norm string")).collect()}
    hashes = {w: h for w, h in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()}
    for k, line in enumerate(lines):
        own = [hashes[w] for w in line.split()]
        want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in own) > len(own))
        assert got[k] & (1 << 64) - 1 == want


def brute_jaccard(rows):
    sets, links = [(i, set(ngram_join.grams(t).tolist())) for i, t in rows], collections.Counter()
    pairs = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    return union_find(pairs, [i for i, _ in sets]), links


def test_ngram_join(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    r = random.Random(2)
    many = [f"v{i}" for i in range(120)]
    rows += [(10_000 + k, " ".join(w if r.random() > 0.01 else "other" for w in many)) for k in range(60)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.classes_of(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    root, links = brute_jaccard(rows)
    assert got == {i: (root[i], links[i]) for i, _ in rows}
    kept = {x.doc_id for x in ngram_join.one_of_each(docs).collect()}
    assert kept == {i for i in root if root[i] == i and i < 10_000}
    assert ngram_join.classes_of(odd).count() == 7 and ngram_join.classes_of(odd.limit(0)).count() == 0
    once = ngram_join.one_of_each(odd)
    assert once.columns == odd.columns and once.where("doc_id = 1").count() == 2


def test_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= ngram_join.MOST_HASHES


def test_secret_scan_is_incremental(spark, odd, tmp_path):
    rows = [(1, "x password: abcdefgh1 y"), (2, "AKIAABCDEFGHIJKL"), (3, "é😀 token=short1 " + "0" * 40), (4, "x password: abcdefgh1 y"), (5, None)]
    df, path = spark.createDataFrame(rows, "doc_id bigint, text string"), f"{tmp_path}/ledger"
    want = {1: (1, 0, 0, "assign:2:21"), 2: (0, 1, 0, "access:0:16"), 3: (0, 0, 1, "hex:16:56"), 4: (1, 0, 0, "assign:2:21"), 5: (0, 0, 0, "")}
    digest = lambda: {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in secret_scan.digest(df, path).collect()}
    assert digest() == want
    ledger = spark.read.parquet(path)
    n = ledger.count()
    assert n == 4 * len(secret_scan.RULES) and secret_scan.scan_unseen(df, ledger).count() == 0
    assert digest() == want and spark.read.parquet(path).count() == n  # a second run scans nothing
    ledger.where("kind = 'assign'").write.mode("append").parquet(path)
    assert digest() == want  # rows appended twice count once
    newer = (*secret_scan.RULES[1:], secret_scan.Rule("assign", 2, secret_scan.RULES[0].pattern, 2, 8))
    assert {(r.kind, r.version) for r in secret_scan.scan_unseen(df, ledger, newer).collect()} == {("assign", 2)}
    assert secret_scan.findings(df, path, newer).where(F.size("found") > 0).count() == 4
    assert secret_scan.digest(odd).count() == 7 and secret_scan.digest(odd.limit(0)).count() == 0


def test_secret_scan_matches_a_plain_scan(spark, docs):
    """Spans of every rule against Python's regular expressions, many matches a text too."""
    many = " ".join(f"token='{'Ab1=' * k}' {'f' * (28 + k)}é AKIA{'Z' * k}" for k in range(60))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, many * 20), (-2, many), (-3, many)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in secret_scan.digest(df).collect():
        found = sorted((m.start(), i, rule.kind, m.end()) for i, rule in enumerate(secret_scan.RULES) for m in re.finditer(rule.pattern, texts[r.doc_id]) if len(m[rule.group]) >= rule.least)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def test_quality(spark, docs, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = quality.learn(big, labels)
    out = quality.score(big, net).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.9
    got = quality.score(odd, net).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and quality.score(odd.limit(0), net).count() == 0
    start, end, text = quality.chunks(np.array([0, 3, 3, 2000]))
    covered = {p for s, e, t in zip(start, end, text) if t == 2 for p in range(s, e)}
    assert covered == set(range(2000 - 3 - quality.WIDTH + 1)) and text.tolist()[:2] == [0, 1]


def test_token_counts(docs, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(bpe_count.MODEL_FILE)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, odd):
        want = sorted((len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in df.collect())
        assert sorted((r.n_bytes, r.n_tokens) for r in bpe_count.count_tokens(df, path).collect()) == want
    pick, counter = random.Random(1), bpe_count.PieceCounter.load(path)
    for _ in range(500):
        text = "".join(pick.choice(" ▁\n\t<s></s>aábé漢😀\x00 the of's.,!\r　") for _ in range(pick.randint(0, 40)))
        assert counter.count(text) == len(model.encode(text))


def test_decontamination(spark, odd):
    item = "Anna has 5 apples and Bert buys 3 kg more of them, then how many apples does Anna hold at the end?"
    bench = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id bigint, text string")
    rows = [
        (1, "before " + item + " after"),
        (2, "So he says Clara has 71 apples and Doug buys 12 km more of them, then how many apples does Clara hold at the end? yes"),
        (3, "So he says Clara has 71 apples and Doug buys 12 km more of them, then how many apples does Doug hold at the end? yes"),
        (4, "other words altogether and nothing of it " * 20),
        (5, item[:40]),
        (6, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()) == [(1, 9), (2, 9)]
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench.limit(0)).count() == 7
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0


def test_decontamination_names_begin_sentences(spark):
    item = "{0} has 3 apples. {1} has 5 pears. {0} gives {1} 2 apples. How many apples does {0} have now?"
    never = "{0} sold some red apples there. Then more came by train. How many apples were left behind at noon?"
    bench = spark.createDataFrame([(9, item.format("Tom", "Sue")), (8, never.format("Tom"))], "item_id bigint, text string")
    rows = [(1, item.format("Ben", "Ann").replace("3", "7")), (2, never.format("Ben")), (3, item.format("Ben", "Ann").replace("does Ben", "does Kim"))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(1, 9), (2, 8)}


def test_decontamination_fillers_may_coincide(spark):
    item = "On one day the baker sold {} loaves before the rain came and then {} loaves after it, so how many loaves were sold in total?"
    bench = spark.createDataFrame([(9, item.format(12, 15))], "item_id bigint, text string")
    rows = [(1, item.format(31, 44)), (2, item.format(20, 20))]
    got = {r.doc_id: (r.n_windows, r.item_windows) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and got[2][0] == got[2][1]


def test_decontamination_quotes_items_without_windows(spark):
    bench = spark.createDataFrame([(1, "Compute 12 + 34 * 5 - 6 / 7"), (2, "Who wrote the Iliad?"), (3, "..."), (4, None)], "item_id bigint, text string")
    rows = [(1, "Task: compute 12 + 34 * 5 - 6 / 7 now"), (2, "compute 12 + 34 * 5 - 6 / 8"), (3, "Tell me: who wrote the Iliad? And when?"), (4, "who wrote the"), (5, None), (6, "who wrote the Iliad"), (7, "...")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()) == [(1, 1), (3, 2), (6, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [2, 4, 5, 7]


def test_main_text(spark):
    page = lambda k, body: (k, f"http://user@Host.example:80/{k}", f"<html><head><title>t</title></head><body><nav><a href=x>m{k}</a></nav><div id=c><p>Share this page</p>{body}</div><footer>f</footer></body></html>")
    rows = [page(k, f"<h2>T{k}</h2><p>a{k} &lt;b&gt;&nbsp;<b>x</b>y<br>z{k}<ul><li>1{k}<li>2{k}</ul><div class='user-comments'>bad</div><script>var a='</p>'</script>") for k in range(8)]
    rows += [(100, None, None), (101, "http://other.example/", "<article><h1>H &amp; I</h1><p>one <i>t</i>wo<p>three &am"), (102, "x", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == ("T3 a3 <b> xy z3 13 23", 21) and got[100] == ("", 0) and got[102] == ("", 0)
    assert got[101][0] == "H & I one two three &am"
    assert wrapper.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_main_text_learns_templates_without_telling_names(spark):
    """Two layouts of a host whose constant parts have no telling element or class; deep and wide pages, repeated rows, clashing names."""
    r = random.Random(4)
    words = made_words(r, 500)
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, want = [], {}
    for k in range(24):
        main = [some(r.randrange(5, 30)) for _ in range(r.randrange(1, 5))]
        want[k] = " ".join(main)
        paragraphs = "".join(f"<p>{m}</p>" for m in main)
        if k % 3:
            body = f"<div class=x1><p>Our house paper</p><p>All rights kept</p></div><div class=x2>{paragraphs}</div><div class=x3><p>Write to us</p></div>"
        else:
            body = f"<table><tr><td>Old pages<td>Sold here</table><section><div>{paragraphs}</div></section><div class=y><p>Made in town</p></div>"
        rows.append((k, f"http://a.example/{k}", f"<html><body>{body}</body></html>"))
    rows += [rows[0], rows[1]]
    deep = "<div>" * 5000 + "<p>low</p>" + "</div>" * 5000
    wide = lambda a, b: "".join(f"<{(a, b)[k % 2]}>t{k}</{(a, b)[k % 2]}>" for k in range(1200))
    rows += [(100 + k, "http://deep.example/", deep.replace("low", f"low{k}")) for k in range(3)] + [(200 + k, "http://wide.example/", "<body>" + wide("p", ("h2", "h3", "pre")[k])) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("h")).withColumn("blocks", F.lit(1)).withColumn("ref", F.lit(1))
    got = collections.defaultdict(list)
    for x in wrapper.main_text(df).collect():
        got[x.page_id].append(x.text)
    assert all(set(got[k]) == {want[k]} for k in want) and len(got[0]) == len(got[1]) == 2
    assert [got[100 + k] for k in range(3)] == [["low0"], ["low1"], ["low2"]]
    assert all(got[200 + k] == [" ".join(f"t{i}" for i in range(1200))] for k in range(3))


def test_tree_match():
    """Against the definition: the largest order-preserving match, by recursion over all pairs."""
    a, b = wrapper.tree("r(a,b(c,d),e)"), wrapper.tree("r(b(d),e,f)")
    assert wrapper.tree_match(a, b) == (4, {0: 0, 2: 1, 4: 2, 5: 3})
    r = random.Random(6)

    def made(depth):
        inner = [made(depth - 1) for _ in range(r.randrange(4) if depth else 0)]
        return r.choice("ab") + (f"({','.join(inner)})" if inner else "")

    def most(x, y):
        if x.label != y.label:
            return 0
        best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, c in enumerate(x.children, 1):
            for j, d in enumerate(y.children, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + most(c, d))
        return 1 + best[-1][-1]

    for _ in range(200):
        a, b = wrapper.tree("r(" + made(3) + "," + made(3) + ")"), wrapper.tree("r(" + made(3) + "," + made(3) + ")")
        size, to = wrapper.tree_match(a, b)
        assert size == len(to) <= most(a, b) and size >= 0.9 * most(a, b)
        assert [to[k] for k in sorted(to)] == sorted(to.values())


def test_tree_match_is_the_largest_at_any_length():
    """Lists of hundreds of children, against a plain table; one that a match from the left alone loses."""
    r = random.Random(9)
    for n, m, letters in ((300, 290, "abc"), (500, 400, "abcdefgh"), (70, 20, "ab"), (30, 90, "abc")):
        x, y = ([r.choice(letters) for _ in range(k)] for k in (n, m))
        a, b = (wrapper.tree("r(" + ",".join(f"{c}({c}x)" if k % 3 else c for k, c in enumerate(z)) + ")") for z in (x, y))
        last = [0] * (m + 1)
        for c in a.children:
            row = [0]
            for j, d in enumerate(b.children):
                both = min(c.size, d.size) if c.label == d.label else 0
                row.append(max(last[j + 1], row[j], last[j] + both))
            last = row
        size, to = wrapper.tree_match(a, b)
        assert size == len(to) == 1 + last[-1]
        assert [to[k] for k in sorted(to)] == sorted(to.values())
    a, b = wrapper.tree("r(z," + "a,b," * 200 + "q)"), wrapper.tree("r(" + "a,b," * 200 + "z,a)")
    assert wrapper.tree_match(a, b)[0] == 401


def test_jpeg_round_trip(spark, docs, odd):
    r = np.random.default_rng(3)
    payloads = [r.integers(0, 256, n, dtype=np.uint8) for n in (64, 128, 64 * 70, 64 * 9000)] + [np.full(64, 255, np.uint8)]
    files = jpeg.encode_all(payloads)
    assert all(jpeg.payload(*x) == p.tobytes() for x, p in zip(jpeg.decode(files), payloads))
    assert jpeg.decode([b"", b"junk", files[0][:40]]) == [None] * 3
    long = media.padded(r.integers(0, 256, 2 * jpeg.MOST_BYTES + 100, dtype=np.uint8).tobytes())
    (whole,) = media.stored([long])
    assert [x[0] for x in media.read_back([whole, files[0]])] == [long, payloads[0].tobytes()] and len(jpeg.images(whole)) == 3
    for df in (docs, odd):
        texts = [r.text or "" for r in df.collect()]
        out = media.digests(df).collect()
        assert sorted(x.n_bytes for x in out) == sorted(len(t.encode()) for t in texts)
        assert all(x.payload_bytes % 64 == 0 and 0 < x.payload_bytes <= x.n_bytes + 64 for x in out)
        assert sorted(x.tail_crc32 for x in out) == sorted(zlib.crc32(media.padded(t.encode())[-64:]) for t in texts)
    seen = media.image_columns(media.text_media(odd).withColumn("width", F.lit("old"))).collect()
    assert len(seen) == 7 and all(x.width == 512 and len(x.thumbnail) == x.width // 8 * (x.height // 8) for x in seen)


def test_jpeg_with_components():
    """4:2:0 with AC coefficients, made here bit by bit."""
    dc, ac = dict(enumerate(jpeg.DC_LENGTHS)), {0: 2, 0x01: 2, 0x12: 3, 0xF0: 4}
    cd, ca = jpeg.codes(dc), jpeg.codes(ac)
    bits = []
    put = lambda v, n: bits.extend(int(b) for b in format(v, f"0{n}b")) if n else None

    def block(diff):
        size = abs(diff).bit_length()
        put(*cd[size])
        put(diff if diff > 0 else diff + (1 << size) - 1, size)
        put(*ca[0x01])
        put(1, 1)
        put(*ca[0xF0])
        put(*ca[0x12])
        put(2, 2)
        put(*ca[0])

    r, luma = random.Random(4), {}
    before = [0, 0, 0]
    for unit in range(6):  # 3 x 2 units of 16 x 16
        for k in range(4):
            v = r.randint(-200, 200)
            luma[unit // 3 * 2 + k // 2, unit % 3 * 2 + k % 2] = v
            block(v - before[0])
            before[0] = v
        for c in (1, 2):
            v = r.randint(-100, 100)
            block(v - before[c])
            before[c] = v
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    frame = jpeg.segment(0xC0, bytes([8, 0, 20, 0, 40, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0, *[4] * 64])) + frame + jpeg.dht(0, dc) + jpeg.dht(0x10, ac) + jpeg.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    h, got = jpeg.decode([data])[0]
    assert (h.width, h.height) == (40, 20) and got.shape == (3, 5)
    assert all(got[i, j] == luma[i, j] for i in range(3) for j in range(5))


def test_pipeline_takes_odd_rows(spark, odd):
    """Nulls, empty, long and repeated rows, and clashing names, through each stage."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0
        assert out.count() == {"language_id": 4}.get(name, out.count())
    assert corpus_pipeline.mix(spark, odd, SF).columns == [*odd.columns, "copy"]


def test_pipeline(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_join", "decontamination", "mixing"]
    now, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        after = now.count()
        assert 0.6 * before < after <= before
    assert corpus_pipeline.run(spark, SF).columns == [*docs.columns, "copy"]
