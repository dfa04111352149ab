"""N-gram Jaccard self-join by MinHash banding.

Band and row counts are chosen for a target recall at the threshold. Documents with the same n-gram set are one text
class; what follows works on classes. Classes that share a band hash become candidates; candidate clusters are the
components of those collisions, and inside a cluster all pairs are verified on full n-gram sets, in blocks: bit
matrices over the n-grams that occur twice, AND and popcount. A block pair returns links per class and a spanning
forest, never the pairs themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, packed, sized, unpacked, without_rows
from spanforge.llm.components import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 128
#: A cluster is cut in blocks of so many classes or n-grams; the work of a task is bounded by a pair of blocks.
BLOCK_CLASSES, BLOCK_GRAMS = 4096, 1 << 21
STEP_DOCS = 400
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band - the fewest false candidates - whose recall at the threshold reaches the target."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most, 1


class Words(dict):
    """64-bit hash of a word, remembered; forgotten all at once when there are many."""

    MOST = 150_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of n words (case folded); a shorter text is one run."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * _MIX + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def sketches(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (bands columns) of each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    joined, heads = np.concatenate(sets), np.cumsum(sizes) - sizes
    keys = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    out = np.full((len(sets), bands), 17, np.uint64)
    for k, key in enumerate(keys):
        x = (joined ^ key) * key
        least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), heads)
        out[:, k // rows] = mixed(out[:, k // rows] * _MIX + least)
    return out


def sketch_rows(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """row (hash of the text), doc_id, class (hash of the n-gram set; null if it is empty), bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP_DOCS):
                part = batch.slice(a, STEP_DOCS)
                sets = [grams(v.as_py(), n) for v in part.column(2)]
                full = [i for i, s in enumerate(sets) if len(s)]
                made = sketches([sets[i] for i in full], bands, rows).view(np.int64) if full else []
                classes: list = [None] * len(sets)
                by: list = [None] * len(sets)
                for i, row in zip(full, made):
                    s = sets[i]
                    classes[i] = int((mixed(s).sum(dtype=np.uint64, keepdims=True) * _MIX + np.uint64(len(s))).view(np.int64)[0])
                    by[i] = row
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(classes, pa.int64()), pa.array(by, pa.list_(pa.int64()))], ["row", "doc_id", "class", "bands"])

    return docs.select(F.xxhash64("text").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "row bigint, doc_id bigint, class bigint, bands array<bigint>")


def gram_rows(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP_DOCS):
                part = batch.slice(a, STEP_DOCS)
                sets = [grams(v.as_py(), n).view(np.int64) for v in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["class", "cluster", "grams"])

    return docs.select("class", "cluster", "text").mapInArrow(run, "class bigint, cluster bigint, grams array<bigint>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections, left by right."""
    joined = np.concatenate([*left, *right])
    names, places, counts = np.unique(joined, return_inverse=True, return_counts=True)
    shared = counts > 1  # a gram of one set alone is in no intersection
    column = np.cumsum(shared) - 1
    sets = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    keep = shared[places]
    sets, places = sets[keep], column[places[keep]]
    out = np.zeros((len(left), len(right)), np.int32)
    for low in range(0, int(shared.sum()), 1 << 15):
        here = (places >= low) & (places < low + (1 << 15))
        bits = np.zeros((len(left) + len(right), 1 << 15), bool)
        bits[sets[here], places[here] - low] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        used = packed.any(axis=0)
        packed = packed[:, used]
        some = np.flatnonzero(packed[len(left) :].any(axis=1))
        other = packed[len(left) + some]
        for i in np.flatnonzero(packed[: len(left)].any(axis=1)):
            out[i, some] += np.bitwise_count(packed[i] & other).sum(axis=1, dtype=np.int32)
    return out


def verify(threshold: float):
    """For a group (cluster, i, j): links of each class and a spanning forest of the similar pairs."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids, own = table["class"].to_numpy(), table["block"].to_numpy()
        weight = table["size"].to_numpy()
        values = table["grams"].combine_chunks()
        flat, at = values.values.to_numpy(), values.offsets.to_numpy()
        order = np.argsort(ids, kind="stable")
        a, b = order[own[order] == i], order[own[order] == j]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        step = 1024

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        size = np.diff(at)
        for p in range(0, len(a), step):
            for q in range(p if i == j else 0, len(b), step):
                x, y = a[p : p + step], b[q : q + step]
                both = overlaps([flat[at[k] : at[k + 1]] for k in x], [flat[at[k] : at[k + 1]] for k in y])
                near = both >= threshold * (size[x][:, None] + size[y][None] - both) - 1e-9
                near &= both > 0
                if i == j and p == q:
                    near &= ~np.eye(len(x), dtype=bool)
                links[x] += near @ weight[y]
                if not (i == j and p == q):
                    links[y] += near.T @ weight[x]
                for r in np.flatnonzero(near.any(axis=1)):
                    t = top(x[r])
                    for c in np.unique(root[y[near[r]]]):
                        u = top(int(c))
                        if u != t:
                            t, u = min(t, u), max(t, u)
                            root[u] = t
        roots = np.array([top(k) for k in range(len(ids))], int)
        return pa.table({"class": ids, "root": ids[roots], "links": links})

    return run


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """row, doc_id, class, group (both hashes; group null if the row stands alone) and n_links of every row.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is at least ``threshold``; n_links counts
    the linked rows, copies too. A text of fewer than n words is one n-gram; a null text or one without words links
    to nothing. Candidates are missed with probability 1 - ``recall`` at the threshold, less above it; inside a cluster
    of candidates none is. Repeated rows are rows of their own; an empty table gives an empty one.
    """
    bands, rows = choose_bands(threshold, recall)
    rowed = materialize(sketch_rows(docs, n, bands, rows), "nj-sketches")
    classes = rowed.where("class is not null").groupBy("class").agg(F.count("*").alias("size"), F.min("row").alias("row"), F.first("bands").alias("bands"))
    keyed = classes.select("class", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first <> last").select("band", "key", "first")
    cluster = components(keyed.join(buckets, ["band", "key"]).select(F.col("class").alias("u"), F.col("first").alias("v")))
    members = materialize(cluster.select(F.col("id").alias("class"), F.col("root").alias("cluster")).join(classes.select("class", "size", "row"), "class"), "nj-members")
    wanted = sized(members.select("row", "class", "cluster"), 24)
    texts = docs.select(F.xxhash64("text").alias("row"), "text").join(wanted, "row").groupBy("class", "cluster").agg(F.first("text").alias("text"))
    sets = materialize(gram_rows(texts, n).join(members.select("class", "size"), "class"), "nj-sets")
    load = sets.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.size("grams").cast("bigint")).alias("g"))
    load = load.select("cluster", F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = sets.join(load, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    pairs = placed.withColumn("p", F.explode(pair)).select("cluster", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "class", "size", "grams")
    found = materialize(pairs.groupBy("cluster", "i", "j").applyInArrow(verify(threshold), "class bigint, root bigint, links bigint"), "nj-found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    facts = classes.select("class", "size").join(links, "class", "left").join(group.select(F.col("id").alias("class"), F.col("root").alias("group")), "class", "left")
    facts = facts.select("class", F.coalesce("group", F.when(F.col("size") > 1, F.col("class"))).alias("group"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    # classes of one row without links need no facts; without them the table mostly fits a broadcast, so no class is dealt to one task
    facts = sized(materialize(facts.where("group is not null"), "nj-facts"), 32)
    return rowed.select("row", "doc_id", "class").join(facts, "class", "left").select("row", "doc_id", "class", "group", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def classes_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of the row's group; its own if it stands alone) and n_links of every row."""
    rows = materialize(near_duplicates(docs, **options), "nj-rows")
    least = sized(materialize(rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("class_id")), "nj-least"), 24)
    return rows.join(least, "group", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, one of each group: the one with the least doc_id, then text hash.

    Of rows equal in both, one stays. Rows that stand alone stay, null and empty ones too. All columns are kept.
    """
    rows = materialize(near_duplicates(docs, **options).where("group is not null").select("row", "doc_id", "group"), "nj-rows")
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")).select("group", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"))
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("row") == F.col("best_row"))
    fate = rows.groupBy("group", "doc_id", "row").agg(F.count("*").alias("times")).join(best, "group").select(F.col("doc_id").alias("nj_id"), F.col("row").alias("nj_row"), stays.alias("stays"), "times")
    fate = materialize(fate.where("not stays or times > 1").withColumnsRenamed({"nj_id": "id", "nj_row": "row"}), "nj-fate")
    out = without_rows(docs, fate.where("not stays"))
    again = fate.where("stays").select(F.col("id").alias("again_id"), F.col("row").alias("again_row"))
    if again.isEmpty():
        return out
    equal = F.col("id").eqNullSafe(F.col("again_id")) & (F.col("row") == F.col("again_row"))
    again, rows = sized(again, 24), packed(out)
    single, copies = rows.join(again, equal, "left_anti"), rows.join(again, equal, "left_semi")
    return unpacked(single, docs.columns).unionByName(unpacked(copies.dropDuplicates(["id", "row"]), docs.columns))
