"""Edits of read tags and headers, and small per-read conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.codec import legacy_fire

#: Fixed values of the alignment format: the flag of a secondary alignment.
SECONDARY = 256
#: A prediction's window, whose half has no call at either end of a read.
WINDOW = 15


def convert_legacy(reads: DataFrame, key: str = "fiber_id") -> DataFrame:
    """``key``, type, fwd_start, length, qual from the legacy arrays ns, nl (nucleosomes), as, al and aq (patches).

    Patches of a positive quality come as fire, too. Arrays of unlike sizes end with the shorter.
    """
    zipped = lambda *names: F.slice(F.arrays_zip(*(F.col(n).alias(k) for n, k in zip(names, ("start", "length", "qual")))), 1, F.least(*(F.size(n) for n in names)))
    item = lambda kind, qual: lambda x: F.struct(F.lit(kind).alias("type"), x["start"].cast("bigint").alias("fwd_start"), x["length"].cast("bigint").alias("length"), (x["qual"].cast("int") if qual else F.lit(None).cast("int")).alias("qual"))
    none = F.array().cast("array<struct<type:string,fwd_start:bigint,length:bigint,qual:int>>")
    parts = [F.transform(zipped("ns", "nl"), item("nuc", False)), F.transform(zipped("as", "al", "aq"), item("msp", True)), F.transform(legacy_fire(F.col("as"), F.col("al"), F.col("aq")), item("fire", True))]
    return reads.select(key, F.inline(F.concat(*(F.coalesce(p, none) for p in parts))))


def haplotag(reads: DataFrame, haplotypes: DataFrame, min_mapq: int = 0) -> DataFrame:
    """``reads`` (chrom, flag, mapq) with HP by contig (``haplotypes``: chrom, hap); an old HP goes.

    Secondary alignments and those of a mapping quality below ``min_mapq`` get none.
    """
    known = haplotypes.select(F.col("chrom").alias("_c"), F.col("hap").alias("_h"))
    sure = (F.col("flag").bitwiseAND(F.lit(SECONDARY)) == 0) & (F.col("mapq") >= min_mapq)
    return reads.drop("HP").join(known, F.col("chrom") == F.col("_c"), "left").withColumn("HP", F.when(sure, F.col("_h"))).drop("_c", "_h")


def merge_headers(own: DataFrame, other: DataFrame) -> DataFrame:
    """Header records (type, line) of ``own`` and those of ``other`` but HD and SQ; read groups of ``other`` take the place of own ones."""
    taken = other.where(~F.col("type").isin("HD", "SQ"))
    groups = taken.where("type = 'RG'").select("type").distinct()
    return own.join(groups, "type", "left_anti").unionByName(taken)


def phred_text(quals: Column) -> Column:
    """Quality string: each value and 33 as a character."""
    return F.array_join(F.transform(quals, lambda q: F.char(q + 33)), "")


def imputed(marked: Column, sequenced: Column, other: Column) -> Column:
    """Marks as if both strands had been sequenced: so many more as the other strand's bases make at the same rate."""
    return marked + F.when(sequenced > 0, F.round(other * marked / sequenced)).otherwise(0).cast("bigint")


def calls_from_scores(scores: DataFrame, table: DataFrame, least: int) -> DataFrame:
    """``scores`` (score in 0 to 1, pos, read_length) with ml by the nearest precision of ``table`` (key: score in thousandths, value).

    Calls below ``least`` go, and those of the first and last half window of a read.
    """
    from spanforge.operators.intervals import nearest

    asked = scores.withColumn("s", F.round(F.col("score") * 1000).cast("bigint"))
    ml = nearest(asked.select("s").distinct(), table).withColumnRenamed("value", "ml")
    half = WINDOW // 2
    return asked.join(ml, "s").drop("s").where((F.col("ml") >= least) & (F.col("pos") >= half) & (F.col("pos") < F.col("read_length") - half))


def mock_windows(items: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """chrom, start, end of windows of about ``size`` that cut no item (chrom, start, end): for contigs as mock reads.

    A contig no longer than ``size`` is one window, a longer one without items gives none. Else windows begin at 0 and then at the first item that starts at or
    behind the open window's end; an item that reaches farther extends the window. Each contig's items are walked in
    order, in Arrow batches of whole contigs.
    """
    import pandas as pd

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "end"])
        length, spans = int(rows["contig_length"].iloc[0]), []
        low, high = 0, length if size >= length else size
        for s, e in zip(rows["start"], rows["end"]):
            if pd.isna(s) or size >= length:
                continue
            if s >= high:
                spans.append((low, high))
                low, high = int(s), int(s) + size
            high = max(high, int(e))
        if size >= length or rows["start"].notna().any():
            spans.append((low, min(high, length)))
        return pd.DataFrame([(rows["chrom"].iloc[0], a, b) for a, b in spans], columns=["chrom", "start", "end"])

    rows = contigs.select("chrom", F.col("length").alias("contig_length")).join(items.select("chrom", "start", "end"), "chrom", "left")
    return rows.groupBy("chrom").applyInPandas(walk, "chrom string, start bigint, end bigint")


def plain_windows(contigs: DataFrame, size: int) -> DataFrame:
    """chrom, start, end of windows of ``size``, the last one shorter: for contigs without items."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint")))
    rows = contigs.where("length > 0").select("chrom", "length", starts.alias("start"))
    return rows.select("chrom", "start", F.least(F.col("start") + size, "length").alias("end"))


#: Fixed value of the alignment format: the flag of a read's further parts.
SUPPLEMENTARY = 2048


def mock_reads(windows: DataFrame, sequences: DataFrame) -> DataFrame:
    """chrom, ref_start, ref_end, flag, cigar and seq of a read for each window (chrom, start, end) of ``sequences`` (chrom, seq).

    All matches; windows behind a contig's first are supplementary. Windows of contigs without a sequence go.
    """
    first = windows.groupBy(F.col("chrom").alias("c")).agg(F.min("start").alias("least"))
    rows = windows.select("chrom", "start", "end").join(first, F.col("chrom") == F.col("c")).join(sequences.select(F.col("chrom").alias("s"), "seq"), F.col("chrom") == F.col("s"))
    n = F.col("end") - F.col("start")
    return rows.select("chrom", F.col("start").alias("ref_start"), F.col("end").alias("ref_end"), F.when(F.col("start") > F.col("least"), SUPPLEMENTARY).otherwise(0).alias("flag"), F.concat(n.cast("string"), F.lit("=")).alias("cigar"), F.substring("seq", F.col("start") + 1, n).alias("seq"))


def on_mock_reads(reads: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` (chrom, start, end, ...) with the read (ref_start) each lies in and its ``fwd_start`` and ``length`` there."""
    from spanforge.operators.intervals import overlap_join

    spans = reads.select(F.col("chrom").alias("b_chrom"), F.col("ref_start").alias("b_start"), F.col("ref_end").alias("b_end"))
    pairs = overlap_join(items, spans).where("b_start <= start and end <= b_end")
    return pairs.select(*items.columns, F.col("b_start").alias("ref_start"), (F.col("start") - F.col("b_start")).alias("fwd_start"), (F.col("end") - F.col("start")).alias("length"))


def bed_of_mock_reads(marks: DataFrame) -> DataFrame:
    """chrom, start, end and the BED columns behind them, from marks of mock reads (chrom, ref_start, fwd_start, length, name).

    A name holds those columns, joined by semicolons, with commas and percent signs percent-coded.
    """
    from spanforge.functions.scalars import percent_decode

    start = F.col("ref_start") + F.col("fwd_start")
    return marks.select("chrom", start.alias("start"), (start + F.col("length")).alias("end"), F.transform(F.split("name", ";"), percent_decode).alias("columns"))


def with_provenance(headers: DataFrame, program: str, version: str, command: str) -> DataFrame:
    """Header records (type, line) and one of the program that ran: its id new among them, behind the last of a chain."""
    field = lambda tag: F.regexp_extract("line", rf"(?:^|\t){tag}:([^\t]*)", 1)
    known = headers.where("type = 'PG'").select(field("ID").alias("id"), field("PP").alias("pp"))
    ends = known.join(known.select(F.col("pp").alias("before")), F.col("id") == F.col("before"), "left_anti")
    # a record a program that ran: some tens in any header
    number = known.where(F.col("id").rlike(f"^{program}(\\.[0-9]+)?$")).agg(F.count("*").alias("n"))
    last = ends.agg(F.max("id").alias("last"))
    name = F.when(F.col("n") == 0, F.lit(program)).otherwise(F.concat(F.lit(f"{program}."), F.col("n").cast("string")))
    parts = F.concat_ws("\t", F.concat(F.lit("ID:"), name), F.lit(f"PN:{program}"), F.lit(f"VN:{version}"), F.concat(F.lit("PP:"), F.col("last")), F.lit(f"CL:{command}"))
    return headers.select("type", "line").unionByName(number.crossJoin(F.broadcast(last)).select(F.lit("PG").alias("type"), parts.alias("line")))
