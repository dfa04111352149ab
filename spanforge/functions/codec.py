"""Tag codecs: MA/AQ/AN annotation strings and MM/ML base modifications.

Strings are emitted and MA is parsed by column expressions; MM/ML walks a sequence base by base, in Python batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

GROUP = re.compile(r"([ACGTUN])([+-])([a-z]+|[0-9]+)([.?]?)((?:,[0-9]+)*);?")


def emit_ma(annotations: DataFrame, key: str = "fiber_id") -> DataFrame:
    """key, ma, aq from (key, read_length, type, spec, strand_mark, fwd_start, length, quals): sections by type and + - . order."""
    rank = F.when(F.col("strand_mark") == "+", 0).when(F.col("strand_mark") == "-", 1).otherwise(2)
    items = annotations.select(key, "read_length", "type", "spec", "strand_mark", rank.alias("rank"), F.struct("fwd_start", "length", "quals").alias("i"))
    sections = items.groupBy(key, "read_length", "type", "spec", "strand_mark", "rank").agg(F.array_sort(F.collect_list("i")).alias("items"))
    text = F.concat("type", "strand_mark", "spec", F.lit(":"), F.array_join(F.transform("items", lambda i: F.concat((i["fwd_start"] + 1).cast("string"), F.lit("-"), i["length"].cast("string"))), ","))
    by = sections.groupBy(key, "read_length").agg(F.array_sort(F.collect_list(F.struct("type", "rank", text.alias("text"), F.flatten(F.transform("items", lambda i: i["quals"])).alias("quals")))).alias("s"))
    return by.select(key, F.concat_ws(";", F.col("read_length").cast("string"), F.array_join(F.transform("s", lambda s: s["text"]), ";")).alias("ma"), F.flatten(F.transform("s", lambda s: s["quals"])).alias("aq"))


def parse_ma(df: DataFrame, ma: str = "ma", aq: str = "aq", key: str = "fiber_id") -> DataFrame:
    """One row an annotation: key, read_length, type, strand_mark, spec, ord, fwd_start, length, quals.

    Qualities are consumed in the order of sections; too few raise an error.
    """
    parts = F.split(F.col(ma), ";")
    sections = df.select(key, aq, F.get(parts, F.lit(0)).cast("bigint").alias("read_length"), F.posexplode(F.slice(parts, 2, 100000)).alias("sec", "text")).where("text <> ''")
    head = F.regexp_extract("text", r"^([^:]*):", 1)
    sections = sections.select(key, aq, "read_length", "sec", F.regexp_extract(head, r"^(.*?)([+.\-])([PQ]*)$", 1).alias("type"), F.regexp_extract(head, r"^(.*?)([+.\-])([PQ]*)$", 2).alias("strand_mark"), F.regexp_extract(head, r"^(.*?)([+.\-])([PQ]*)$", 3).alias("spec"), F.split(F.regexp_extract("text", r":(.*)$", 1), ",").alias("items"))
    from pyspark.sql import Window

    width = F.size("items") * F.length("spec")
    sections = sections.withColumn("before", F.coalesce(F.sum(width).over(Window.partitionBy(key).orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = sections.select(key, aq, "read_length", "type", "strand_mark", "spec", "before", F.posexplode("items").alias("ord", "item"))
    first, n = (F.col("before") + F.col("ord") * F.length("spec")).cast("int"), F.length("spec")
    enough = F.assert_true(first + n <= F.size(F.coalesce(F.col(aq), F.array())), "too few qualities").isNull()
    return rows.where(enough).select(key, "read_length", "type", "strand_mark", "spec", "ord", (F.split("item", "-")[0].cast("bigint") - 1).alias("fwd_start"), F.split("item", "-")[1].cast("bigint").alias("length"), F.slice(F.coalesce(F.col(aq), F.array().cast("array<int>")), first + 1, n).alias("quals"))


def parse_mm_text(mm: str, ml: list[int], seq: str) -> list[tuple[str, str, int, int]]:
    """(code, strand, position, quality): multi-letter groups give one mark a letter; a short ML counts as 0."""
    out, used = [], 0
    for base, strand, code, _, deltas in GROUP.findall(mm):
        codes = [code] if code.isdigit() else list(code)
        skips = [int(x) for x in deltas[1:].split(",")] if deltas else []
        places = range(len(seq)) if base == "N" else [i for i, b in enumerate(seq) if b == base]
        at = -1
        for s in skips:
            at += s + 1
            for c in codes:
                quality = ml[used] if used < len(ml) else 0
                used += 1
                if at < len(places):
                    out.append((c, strand, places[at], quality))
    return sorted(out, key=lambda x: (x[0], x[1], x[2]))


def emit_mm_text(marks: list[tuple[str, str, str, int, int]], seq: str) -> tuple[str, list[int]]:
    """MM and ML of (base, strand, code, position, quality): groups by base, strand and code, delta-coded."""
    mm, ml = [], []
    for base, strand, code in sorted({m[:3] for m in marks}):
        mine = sorted((p, q) for b, s, c, p, q in marks if (b, s, c) == (base, strand, code))
        places = {p: i for i, p in enumerate(range(len(seq)) if base == "N" else [i for i, x in enumerate(seq) if x == base])}
        last, deltas = -1, []
        for p, q in mine:
            if p in places:
                deltas.append(places[p] - last - 1)
                last = places[p]
                ml.append(q)
        mm.append(f"{base}{strand}{code}{''.join(f',{d}' for d in deltas)};")
    return "".join(mm), ml


MARKS = ArrayType(StructType([StructField("code", StringType()), StructField("strand", StringType()), StructField("pos", IntegerType()), StructField("qual", IntegerType())]))
TAGS = StructType([StructField("mm", StringType()), StructField("ml", ArrayType(IntegerType()))])


@pandas_udf(MARKS)
def parse_mm(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for mm, ml, seq in batches:
        yield pd.Series([[{"code": c, "strand": s, "pos": p, "qual": q} for c, s, p, q in parse_mm_text(m or "", list(a) if a is not None else [], t or "")] for m, a, t in zip(mm, ml, seq)])


@pandas_udf(TAGS)
def emit_mm(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for marks, seq in batches:
        made = [emit_mm_text([(x["base"], x["strand"], x["code"], x["pos"], x["qual"]) for x in (m if m is not None else [])], t or "") for m, t in zip(marks, seq)]
        yield pd.DataFrame({"mm": [m for m, _ in made], "ml": [a for _, a in made]})


def legacy_fire(as_: Column, al: Column, aq: Column) -> Column:
    """Entries of the legacy patch arrays with a positive quality."""
    return F.filter(F.arrays_zip(as_.alias("start"), al.alias("length"), aq.alias("qual")), lambda x: x["qual"] > 0)


def merge_missing(own: DataFrame, other: DataFrame, key: str = "fiber_id") -> DataFrame:
    """``own`` and the rows of ``other`` whose (key, type) it lacks."""
    return own.unionByName(other.join(own.select(key, "type").distinct(), [key, "type"], "left_anti").select(own.columns))


def drop_tags(tags: Column, names: tuple[str, ...] = ("fi", "fp", "ri", "rp")) -> Column:
    """Tags without the kinetics."""
    return F.map_filter(tags, lambda k, _: ~k.isin(*names))


def ddda_to_m6a(seq: Column) -> Column:
    """Y to T or R to A with the marks' base; both in one read is an error, neither leaves it."""
    y, r = seq.contains("Y"), seq.contains("R")
    checked = F.when(F.assert_true(~(y & r), "a read with both Y and R").isNull(), seq)
    places = lambda b: F.filter(F.transform(F.split(checked, ""), lambda c, i: F.when(c == b, i)), lambda x: x.isNotNull())
    return F.struct(F.translate(checked, "YR", "TA").alias("seq"), F.when(y, F.lit("T-a")).when(r, F.lit("A+a")).alias("code"), F.when(y, places("Y")).when(r, places("R")).alias("marks"))
