"""Scalar functions of the model as column expressions; ``register`` makes some of them SQL functions' bodies."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spanforge.model import FIRE_COLORS, SCORE_SCALE


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def upper_bases(seq: Column) -> Column:
    return F.translate(seq, "acgtn", "ACGTN")


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def one_hot(seq: Column) -> Column:
    """Four arrays, of A, C, G and T, of 0 and 1 by base."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    marked = lambda base: F.transform(letters, lambda c: (c == base).cast("int"))
    return F.array(*map(marked, "ACGT"))


def percent_encode(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit(","), F.lit("%2C"))


def percent_decode(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%2C"), F.lit(",")), F.lit("%25"), F.lit("%"))


def strip_prefix(contig: Column, delimiter: str = "#") -> Column:
    """What follows the second delimiter; '' if there are fewer than two."""
    parts = F.split(contig, f"\\Q{delimiter}\\E")
    return F.when(F.size(parts) < 3, "").otherwise(F.array_join(F.slice(parts, 3, 1000000), delimiter))


def haplotype(contig: Column, first: str, second: str) -> Column:
    one, two = contig.contains(first), contig.contains(second)
    return F.when(one & ~two, 1).when(two & ~one, 2)


def kinetics_to_u8(v: Column) -> Column:
    """Lossy code of frame counts: steps of 1, 2, 4 and 8 in four ranges, 255 above."""
    return F.when(v < 64, v).when(v < 191, F.floor((v - 64) / 2) + 64).when(v < 445, F.floor((v - 192) / 4) + 128).when(v < 953, F.floor((v - 448) / 8) + 192).otherwise(255).cast("int")


def fire_weight(qual: Column) -> Column:
    """min(100, -50 log10(1 - q / 255)), q at most 253, in millionths: whole numbers, so running sums cancel exactly."""
    x = F.least(F.lit(100.0), F.log10(F.lit(1.0) - F.least(qual, F.lit(253)) / F.lit(255.0)) * -50.0)
    return F.round(x * SCORE_SCALE).cast("bigint")


def fire_color(qual: Column) -> Column:
    """Colour of an element's FDR in percent, 100 - q / 255 * 100: the first bound that isn't below it."""
    fdr = F.lit(100.0) - qual / F.lit(255.0) * 100.0
    out = F.lit(FIRE_COLORS[-1][1])
    for bound, color in reversed(FIRE_COLORS[:-1]):
        out = F.when(fdr <= bound, color).otherwise(out)
    return out


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(both <= 0, 0.0).otherwise(F.least(both / (e1 - s1), both / (e2 - s2)))


def fold_change(marked: Column, fraction: Column, total: Column) -> Column:
    """log2 of marked over expected; 0 if either is 0."""
    expected = fraction * total
    return F.when((marked <= 0) | (expected <= 0), 0.0).otherwise(F.log2(marked / expected))


def footprint_code(spans: Column, marked: list[Column]) -> Column:
    """Bit 0: a spanning patch; bit i + 1: module i without a mark."""
    out = spans.cast("int")
    for i, m in enumerate(marked):
        out = out.bitwiseOR(F.when(m, 0).otherwise(1 << (i + 1)).cast("int"))
    return out


# Read tags and read names of the two platforms.
PACBIO_TAGS, ONT_TAGS = ("zm", "np", "rq", "sn"), ("mx", "ch", "st", "du", "ts")
PACBIO_NAME, ONT_NAME = r"^m\w+/\d+/", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def platform(tags: Column, name: Column) -> Column:
    """Sequencing platform by read tags - contradictory ones tell nothing - then by the read's name."""
    has = lambda names: F.exists(F.map_keys(tags), lambda k: k.isin(*names))
    pacbio, ont = has(PACBIO_TAGS), has(ONT_TAGS)
    return F.when(pacbio & ~ont, "pacbio").when(ont & ~pacbio, "ont").when(name.rlike(PACBIO_NAME), "pacbio").when(name.rlike(ONT_NAME), "ont").otherwise("unknown")


SQL_FUNCTIONS = {
    "revcomp": "(s STRING) RETURNS STRING RETURN translate(reverse(s), 'ACGTacgt', 'TGCAtgca')",
    "reciprocal_overlap": "(s1 BIGINT, e1 BIGINT, s2 BIGINT, e2 BIGINT) RETURNS DOUBLE RETURN CASE WHEN least(e1, e2) <= greatest(s1, s2) THEN 0D ELSE least((least(e1, e2) - greatest(s1, s2)) / (e1 - s1), (least(e1, e2) - greatest(s1, s2)) / (e2 - s2)) END",
    "fire_weight": "(q INT) RETURNS BIGINT RETURN CAST(round(least(100D, -50D * log10(1 - least(q, 253) / 255D)) * 1000000) AS BIGINT)",
    "hp": "(tag INT) RETURNS STRING RETURN coalesce(concat('H', tag), 'UNK')",
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of the scalars."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
