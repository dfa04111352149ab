"""Benchmark decontamination by template canonicalisation.

Numbers, units after a number, and names (capitalised words inside a sentence) become typed placeholders; what is left
in lower case is the template. Windows of ``WINDOW`` template tokens of documents and benchmark items meet in a hash
join. A join hit carries the slot fillers of both sides; along one alignment of a document and an item they must be
consistent: one filler of the item always stands for the same filler in the document. So a question with other names
and numbers is found, and text that shares nothing but placeholders isn't.

A capitalised word that begins a sentence may be a name or not: its windows come in both forms, and meet in either. If the
word stands inside a sentence of its text, too, it is a name; if not, and its fillers are not consistent, its windows alone
count for nothing.

An item without a window - short, or mostly of numbers and names - is looked for as it is: its tokens in lower case, all of
them in a row.

Only windows that pass a bitmap of the benchmark's windows leave the scan of the documents; the bitmap has a fixed
size, however large the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, without_rows

WINDOW, SHARE, RUN = 5, 0.6, 9
BITMAP_BITS = 22
STEP_CHARS = 1 << 20
TOKEN = re.compile(r"\w+(?:[.,]\d+)*|[.!?:;\n]")
#: Units that are placeholders after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres cup cups gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros usd eur degree degrees mph kmh kb mb gb tb hz watt watts volt volts".split()
)
WORD, NUMBER, NAME, UNIT, STOP, MAYBE = range(6)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: An odd number and its inverse modulo 2 ** 64.
_BASE, _BACK = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class Tokens(dict):
    """token -> its number in ``hashes`` (of its lower case) and ``kinds``; bounded."""

    MOST = 200_000

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds = np.zeros(self.MOST, np.uint64), np.zeros(self.MOST, np.int8)

    def __missing__(self, token: str) -> int:
        import xxhash

        low, number = token.lower(), len(self)
        self.kinds[number] = STOP if token in ".!?:;\n" else NUMBER if any(c.isdigit() for c in token) else NAME if token[0].isupper() and token[1:] == low[1:] and len(token) > 1 else UNIT if low in UNITS else WORD
        self.hashes[number] = xxhash.xxh3_64_intdigest(low)
        self[token] = number
        return number

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and kinds; all is forgotten first if these might not fit."""
        if len(self) + len(tokens) > self.MOST:
            self.clear()
            if len(tokens) > self.MOST:
                parts = [self.of(tokens[k : k + self.MOST]) for k in range(0, len(tokens), self.MOST)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.hashes[numbers], self.kinds[numbers]


_TOKENS = Tokens()


def canonical(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, the places of those that aren't stops, and of these the template hashes, their slot kind (WORD: none), text number, and which are capitalised and begin a sentence (WORD here)."""
    lists = [TOKEN.findall(t) for t in texts]
    tokens = [t for ts in lists for t in ts]
    text = np.repeat(np.arange(len(texts)), [len(ts) for ts in lists])
    if not tokens:
        return [], np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), text, np.zeros(0, bool)
    hashes, kinds = _TOKENS.of(tokens)
    first = np.r_[True, (kinds[:-1] == STOP) | (text[1:] != text[:-1])]
    maybe = first & (kinds == NAME)
    kinds[maybe] = WORD
    after_number = np.r_[False, (kinds[:-1] == NUMBER) & (text[1:] == text[:-1])]
    kinds[(kinds == UNIT) & ~after_number] = WORD
    keep = kinds != STOP
    hashes, kinds, text = hashes[keep], kinds[keep], text[keep]
    slot = kinds != WORD
    hashes[slot] = kinds[slot].astype(np.uint64)
    return tokens, np.flatnonzero(keep), hashes, kinds, text, maybe[keep]


def windows(hashes: np.ndarray, kinds: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows inside one text; windows mostly of placeholders are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    slots = np.zeros(n, int)
    for k in range(width):
        x = out * _MIX + hashes[k : n + k]
        out = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slots += kinds[k : n + k] != WORD
    at = np.flatnonzero((text[:n] == text[width - 1 :]) & (slots * 2 <= width))
    return at, out[at]


def window_rows(rows: DataFrame, width: int, bitmap: np.ndarray | None) -> DataFrame:
    """id, row (hash of the text), place, total, key, form (1: words that may be names are) and slots of the windows (that pass ``bitmap``, if given)."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    schema = "id bigint, row bigint, place int, total int, key bigint, form tinyint, slots array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = shared.value
        for batch in batches:
            values, at, chars, text_rows = batch.column(2).to_pylist(), 0, 0, []
            for i, v in enumerate(values):
                chars += len(v or "")
                if chars >= STEP_CHARS or i + 1 == len(values):
                    text_rows.append((at, i + 1))
                    at, chars = i + 1, 0
            for a, b in text_rows:
                tokens, places, hashes, kinds, text, maybe = canonical([v or "" for v in values[a:b]])
                heads = np.searchsorted(text, np.arange(b - a + 1))
                first, keys = windows(hashes, kinds, text, width)
                # the other form of windows with a word that may be a name
                named = np.where(maybe, NAME, kinds)
                first_n, keys_n = windows(np.where(maybe, np.uint64(NAME), hashes), named, text, width)
                count = np.concatenate([[0], np.cumsum(maybe)])
                two = count[first_n + width] > count[first_n]
                form = np.repeat([0, 1], [len(first), int(two.sum())])
                first, keys = np.concatenate([first, first_n[two]]), np.concatenate([keys, keys_n[two]])
                if passes is None:
                    total = np.bincount(text[np.unique(first)], minlength=b - a)  # of all windows, for the benchmark
                else:
                    bit = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    hit = (passes[bit >> 3] >> (bit & 7)) & 1 > 0
                    first, keys, form = first[hit], keys[hit], form[hit]
                    total = np.zeros(b - a, int)
                owner = text[first]
                inside = {}

                def filler(k: int) -> str:
                    low = tokens[places[k]].lower()
                    if not maybe[k]:
                        return f"{kinds[k]}{low}"
                    if text[k] not in inside:
                        own = np.arange(heads[text[k]], heads[text[k] + 1])
                        inside[text[k]] = {tokens[places[j]].lower() for j in own[kinds[own] == NAME]}
                    return f"{NAME if low in inside[text[k]] else MAYBE}{low}"

                slots = [[filler(k) for k in range(f, f + width) if (named if n else kinds)[k] != WORD] for f, n in zip(first.tolist(), form.tolist())]
                pick = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array((first - heads[owner]).astype(np.int32)), pa.array(total[owner].astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(form.astype(np.int8)), pa.array(slots, pa.list_(pa.string()))],
                    ["id", "row", "place", "total", "key", "form", "slots"],
                )

    return rows.mapInArrow(run, schema)


def run_keys(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and keys of all runs of ``n`` tokens inside one text; differences of one running sum, so any length costs the same."""
    at = np.flatnonzero(text[: max(0, len(text) - n + 1)] == text[n - 1 :])
    power = np.full(len(hashes) + 1, _BASE, np.uint64)
    power[0] = 1
    back = np.full(len(hashes) + 1, _BACK, np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power)[:-1], dtype=np.uint64)])
    x = (sums[at + n] - sums[at]) * np.cumprod(back)[at] + np.uint64(n) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return at, x ^ (x >> np.uint64(32))


def run_rows(rows: DataFrame, lengths: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """id, row, n and key of the runs of ``lengths`` tokens (that pass ``bitmap``), or of each text as a whole."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(2).to_pylist()):
                tokens = [t for t in TOKEN.findall(value or "") if t not in ".!?:;\n"]
                if not tokens:
                    continue
                hashes, own = _TOKENS.of(tokens)[0], np.zeros(len(tokens), int)
                for n in lengths if lengths is not None else [len(tokens)]:
                    if n > len(tokens):
                        break
                    keys = np.unique(run_keys(hashes, own, n)[1])
                    if shared.value is not None:
                        bit = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                        keys = keys[(shared.value[bit >> 3] >> (bit & 7)) & 1 > 0]
                    if len(keys):
                        pick = pa.array(np.full(len(keys), i))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64))], ["id", "row", "n", "key"])

    return rows.mapInArrow(run, "id bigint, row bigint, n int, key bigint")


def exact(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """doc_id, doc_row and item_id where the whole of an item stands in the document; None if no item has a token."""
    whole = materialize(run_rows(items, None, None), "dc-whole")
    lengths = sorted(r.n for r in whole.select("n").distinct().collect())
    if not lengths:
        return None
    found = run_rows(docs, lengths, bitmap_of(whole))
    return found.join(whole.select("key", "n", F.col("id").alias("item_id")), ["key", "n"]).select(F.col("id").alias("doc_id"), F.col("row").alias("doc_row"), "item_id").distinct()


def bitmap_of(items: DataFrame) -> np.ndarray:
    """Of the leading bits of all windows' keys: at most 2 ** BITMAP_BITS different values come to the driver."""
    bit = F.shiftrightunsigned("key", 64 - BITMAP_BITS).cast("int")
    bits = np.array(items.select(bit.alias("b")).distinct().toArrow().column("b").to_numpy(), np.int64)
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    np.bitwise_or.at(out, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """doc_id, doc_row (hash of the text), item_id, n_windows and item_windows of the contaminated pairs.

    A pair counts if ``share`` of the item's windows, or ``run`` at one alignment, occur in the document with consistent
    slots; an item without a window that is half words counts as one window, all its tokens as they are. A null or empty
    text, on either side, matches nothing. Items of equal id and different text are items of their own; repeated documents are reported once for each
    doc_id and text. Empty tables give an empty result; other columns are ignored.
    """
    named = lambda df, name: df.select(F.col(name).cast("bigint").alias("id"), F.xxhash64("text").alias("row"), "text")
    texts = named(benchmark, "item_id").distinct()
    items = materialize(window_rows(texts, width, None), "dc-items")
    bitmap = bitmap_of(items)
    found = window_rows(named(docs, "doc_id"), width, bitmap)
    b = items.select("key", F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("place").alias("item_place"), F.col("total").alias("item_windows"), F.col("form").alias("item_form"), F.col("slots").alias("item_slots"))
    hits = found.join(b, "key").select(F.col("id").alias("doc_id"), F.col("row").alias("doc_row"), "item_id", "item_row", "item_windows", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), ((F.col("form") == 0) & (F.col("item_form") == 0)).alias("plain"), F.arrays_zip("item_slots", "slots").alias("slots"))
    pair = ["doc_id", "doc_row", "item_id", "item_row", "item_windows"]
    alignment = hits.groupBy(*pair, "shift").agg(F.collect_set(F.struct("item_place", "slots", "plain")).alias("windows"))
    slots = lambda windows: F.array_distinct(F.flatten(F.transform(windows, lambda w: w["slots"])))
    sides = F.transform("slots", lambda s: s["item_slots"])
    one_way = lambda slots: F.size(F.array_distinct(F.transform(slots, lambda s: s["item_slots"]))) == F.size(slots)
    both_ways = lambda slots: one_way(slots) & (F.size(F.array_distinct(F.transform(slots, lambda s: s["slots"]))) == F.size(slots))
    at = lambda windows: F.array_distinct(F.transform(windows, lambda w: w["item_place"]))
    torn = F.filter(F.array_distinct(sides), lambda x: x.startswith(str(MAYBE)) & (F.size(F.filter(sides, lambda y: x == y)) > 1))
    # a word that may be no name takes its windows out, not the alignment
    alignment = alignment.withColumn("slots", slots("windows")).withColumn("torn", F.when(one_way(F.col("slots")), F.array().cast("array<string>")).otherwise(torn))
    alignment = alignment.withColumn("kept", F.filter("windows", lambda w: ~F.exists(w["slots"], lambda s: F.array_contains("torn", s["item_slots"]))))
    alignment = alignment.withColumn("bare", F.filter("windows", lambda w: w["plain"])).withColumn("slots", slots("kept")).withColumn("bare_slots", slots("bare"))
    # two fillers of the item may have become the same one; where the names that begin sentences speak against an
    # alignment, it counts without them if its other fillers stand one for one
    lined = alignment.withColumn("places", F.when(one_way(F.col("slots")), at("kept")).when(both_ways(F.col("bare_slots")), at("bare")).otherwise(F.array().cast("array<int>")))
    lined = lined.withColumn("n", F.size("places")).where("n > 0")
    # places may be shared by alignments: each counts once, for the whole document
    by = lined.groupBy(*pair).agg(F.max("n").alias("longest"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n_windows"))
    out = by.where((F.col("n_windows") >= F.col("item_windows") * share) | (F.col("longest") >= run)).select("doc_id", "doc_row", "item_id", F.col("n_windows").cast("bigint").alias("n_windows"), F.col("item_windows").cast("bigint").alias("item_windows"))
    bare = texts.join(items.select(F.col("id").alias("i"), F.col("row").alias("r")).distinct(), F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left_anti")
    quoted = exact(named(docs, "doc_id"), bare)
    return out if quoted is None else out.unionByName(quoted.select("*", F.lit(1).cast("bigint").alias("n_windows"), F.lit(1).cast("bigint").alias("item_windows")))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows: see ``matches``."""
    return matches(docs, benchmark, **options).select("doc_id", "item_id", "n_windows", "item_windows").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; null and empty texts stay."""
    bad = matches(docs, benchmark, **options).select(F.col("doc_id").alias("id"), F.col("doc_row").alias("row")).distinct()
    return without_rows(docs, materialize(bad, "dc-bad"))
