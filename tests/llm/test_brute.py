"""Operators without SQL, each against its definition written out plainly; a corpus with planted cases through the pipeline."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import decontaminate, langid, quality


def made_words(r, n, letters="abcdefghijklmnop"):
    return ["".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(n)]


def test_phrases_are_longest_matches():
    """Each phrase goes on while the learned text holds it; a symbol that the text lacks begins one."""
    r = random.Random(3)
    langs = {"a": made_words(r, 60, "abcdeé"), "b": made_words(r, 60, "defgß漢")}
    learned = {k: [" ".join(r.choice(w) for _ in range(80)).encode() for _ in range(3)] for k, w in langs.items()}
    parser = langid.CrossParser(learned)
    mixed = sum(langs.values(), []) + ["Zoo", "ÜBER", "x-1"]
    texts = [" ".join(r.choice(mixed) for _ in range(r.randrange(1, 400))).encode() for _ in range(25)]
    offsets = np.cumsum([0, *map(len, texts)])
    rates = parser.rates(np.frombuffer(b"".join(texts), np.uint8), offsets)

    def folded(text):
        out = [c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in text]
        return bytes(c for i, c in enumerate(out) if not (c == 32 and i and out[i - 1] == 32))

    for i, text in enumerate(texts):
        symbols = folded(text)
        for k, lang in enumerate(parser.langs):
            own, phrases = folded(b" ".join(learned[lang])), 0
            for at in range(0, len(symbols), langid.BLOCK):
                phrases, now = phrases + 1, b""
                for c in symbols[at : at + langid.BLOCK]:
                    longer = now + bytes([c])
                    if longer in own:
                        now = longer
                    else:
                        phrases, now = phrases + 1, bytes([c]) if bytes([c]) in own else b""
            assert np.isclose(rates[i, k], phrases * np.log2(len(own)) / len(symbols))


def test_probabilities_are_a_plain_convolution():
    r = np.random.default_rng(5)
    net = quality.ByteNet()
    net.bias, net.base = r.normal(0, 0.2, quality.FILTERS), 0.1
    texts = [r.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 3, 4, 5, 100, 511, 512, 515, 516, 1500, 4000)]
    got = net.probabilities(texts, net.tables())
    for text, p in zip(texts, got):
        text = np.pad(text, (0, max(0, quality.WIDTH - len(text))), constant_values=32)
        response = np.array([sum(net.filters[o, text[i + o]] for o in range(quality.WIDTH)) for i in range(len(text) - quality.WIDTH + 1)]) + net.bias
        step, pooled, at = quality.CHUNK - quality.OVERLAP, [], 0
        while True:
            pooled.append(np.maximum(response[at : at + quality.CHUNK].max(axis=0), 0))
            if at + quality.CHUNK >= len(response):
                break
            at += step
        want = 1 / (1 + np.exp(-(np.mean(pooled, axis=0) @ net.weights + net.base)))
        assert np.isclose(p, want, atol=1e-4)


def test_decontamination_finds_random_reparameterisations(spark):
    """Items with numbers and names replaced, two of them by the same one at times; other texts of the same words stay."""
    r = random.Random(17)
    words, names = made_words(r, 400), ["Anna", "Bert", "Clara", "Doug", "Emma", "Fred", "Gina", "Hugo"]
    items, rows = [], []
    for k in range(40):
        n, slots = r.randrange(18, 40), {}
        template = [r.choice(words) for _ in range(n)]
        for at in r.sample(range(2, n, 4), r.randrange(2, 4)):
            slots[at] = r.choice(["number", "name"])
        fill = {at: str(r.randrange(2, 99)) if kind == "number" else r.choice(names) for at, kind in slots.items()}
        items.append((k, " ".join(fill.get(i, w) for i, w in enumerate(template))))
        to = {f: str(r.randrange(100, 110)) if f.isdigit() else r.choice(names[:3]) for f in set(fill.values())}
        other = " ".join(to[fill[i]] if i in fill else w for i, w in enumerate(template))
        noise = lambda: " ".join(r.choice(words) for _ in range(r.randrange(30)))
        rows += [(2 * k, f"{noise()} so {other} and {noise()}"), (2 * k + 1, f"{noise()} {' '.join(r.sample(template, n))} {noise()}")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(2 * k, k) for k in range(40)}


def test_pipeline_on_planted_cases(spark, tmp_path):
    """What has to go goes, whatever else is in the corpus; clean documents come out as they are, or not at all in the mix."""
    r = random.Random(29)
    langs = {"xx": made_words(r, 300, "abcdefgh"), "yy": made_words(r, 300, "opqrstuv")}
    text = lambda lang, lines: "\n".join(" ".join(r.choice(langs[lang]) for _ in range(r.randrange(12, 30))) for _ in range(lines))
    rows, fate = [], {}

    def add(body, what, lang):
        rows.append((len(rows), body, lang, r.choice("st"), len(body or "")))
        fate[rows[-1][0]] = what

    for lang in langs:
        clean = [text(lang, r.randrange(3, 7)) for _ in range(40)]
        for body in clean:
            add(body, "clean", lang)
        for body in clean[:6]:
            add(body, "copy", lang)  # every line repeats
        notice = " ".join(r.choice(langs[lang]) for _ in range(20))
        for k in range(5):
            add(text(lang, 3) + "\n" + notice.replace(notice.split()[4], f"word{'abcde'[k]}", 1), "notice", lang)
    items = [" ".join(r.choice(langs["xx"]) for _ in range(25)) for _ in range(3)]
    for item in items:
        add(text("xx", 2) + " " + item + " " + text("xx", 2), "leak", "xx")
    add("12 34 !!", "no letter", None)
    add(None, "null", "xx")
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, stays = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        stays[name] = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    last = stays["decontamination"]
    kinds = collections.defaultdict(list)
    for k, what in fate.items():
        kinds[what].append(k)
    assert all(last.get(k) == rows[k][1] for k in kinds["clean"])
    assert not any(k in last for what in ("copy", "leak", "no letter", "null") for k in kinds[what])
    for lang in langs:
        mine = [k for k in kinds["notice"] if rows[k][2] == lang]
        assert [last[k].count("\n") for k in mine] == [3, 2, 2, 2, 2]
    mixed = corpus_pipeline.run(spark, folder)
    assert mixed.where(F.col("copy") > 2).count() == 0
    assert {(x.doc_id, x.text) for x in mixed.select("doc_id", "text").collect()} <= set(last.items())
