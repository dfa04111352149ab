"""Secret scans over an incremental blob ledger.

Every historical version is content-addressed (SHA-256 of its text). The ledger, a Parquet table, holds for each blob
and rule version scanned so far the spans found. A run scans only the blob and rule-version pairs the ledger lacks,
once a blob however many paths share it, appends what it found, and joins the ledger's findings back to all paths. SQL
functions only.

Spans are found without user code: the pieces that ``split`` leaves and the matches of ``regexp_extract_all``
alternate, so running sums of their lengths give the places (code points, end exclusive).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import shared_dir

SPANS = "array<struct<start:bigint,end:bigint>>"
LEDGER = f"blob string, kind string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters; ``hint`` must occur."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


#: The order is that of kinds where spans start alike. The first three are the base rules.
RULES = (
    Rule("assign", 1, r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
BASE = ("assign", "access", "hex")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: blob, kind, version, spans of the blob and rule-version pairs ``ledger`` lacks, with findings or not.

    ``versions`` has a ``text`` column; equal texts are one blob, a null text is the empty one.
    """
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    names = F.array(*(F.lit(r.name) for r in rules))
    if ledger is None:
        pending = blobs.withColumn("pending", names)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "kind", F.col("version").cast("string"))).alias("seen"))
        pending = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("pending") > 0)

    def scanned(r: Rule) -> Column:
        """The rule's matches with the lengths of the pieces before them; none where a cheap test finds none."""
        present = F.col("text").contains(r.hint) & F.col("text").rlike(r.pattern) if r.hint else F.col("text").rlike(r.pattern)
        found = F.arrays_zip(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("m"), F.split("text", r.pattern, -1).alias("p"))
        group = lambda m: F.regexp_extract(m, r.pattern, r.group) if r.group else m
        sizes = F.transform(found, lambda x: F.struct(F.char_length(x["p"]).cast("bigint").alias("before"), F.char_length(x["m"]).cast("bigint").alias("size"), (F.char_length(group(x["m"])) >= r.least).alias("enough")))
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(present, sizes).alias("matches"))

    each = F.array_compact(F.array(*(F.when(F.array_contains("pending", r.name), scanned(r)) for r in rules)))
    matches = pending.select("blob", F.explode(each).alias("f")).select("blob", "f.kind", "f.version", F.posexplode_outer("f.matches").alias("i", "m"))
    # running sums along a blob's matches; the piece behind the last one has no match
    along = Window.partitionBy("blob", "kind", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = matches.select("blob", "kind", "version", F.col("m.size").alias("size"), F.col("m.enough").alias("enough"), F.sum(F.col("m.before") + F.coalesce("m.size", F.lit(0))).over(along).alias("end"))
    span = F.when(F.col("enough"), F.struct((F.col("end") - F.col("size")).alias("start"), "end"))
    return ends.groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger at ``path`` (made if there is none) after what it lacks of ``versions`` was scanned and appended."""
    spark = versions.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    new = scan_unseen(versions, spark.read.schema(LEDGER).parquet(path) if there else None, rules)
    new.select("blob", "kind", "version", F.col("spans").cast(SPANS)).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``blob`` and ``found``: array<struct<start, place, kind, end>> by start, then rule order; see ``update``.

    Every row (path) of ``versions`` is kept, repeated and null ones too; an empty table gives an empty one. Columns
    named blob or found are replaced. A ledger row counts once however often it was appended.
    """
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    current = F.concat_ws("/", "kind", F.col("version").cast("string")).isin(*(r.name for r in rules))
    known = update(versions, path, rules).where(current & (F.size("spans") > 0))
    flat = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("place"), F.col("kind").alias("kind"), s["end"].alias("end")))
    by_blob = known.select("blob", F.explode(flat).alias("found")).groupBy("blob").agg(F.array_sort(F.collect_set("found")).alias("found"))
    base = versions.drop("blob", "found").withColumn("blob", blob_of(F.col("text")))
    return base.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")))


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row's whole text (null: empty).

    The ledger is a new one in the shared folder; give a path to keep it between runs.
    """
    path = ledger or f"{shared_dir(docs.sparkSession).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    rows = findings(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), path)
    text = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return rows.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def _sql() -> str:
    kinds = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        test = f"length(regexp_extract(ms[i], '{pattern}', {r.group})) >= {r.least}"
        kinds.append(
            f"SELECT doc_id, rid, {i} AS place, '{r.kind}' AS kind, s AS start, s + length(m) AS stop FROM (SELECT doc_id, rid, unnest(list_filter(list_transform(range(1, len(ms) + 1), lambda i: struct_pack("
            f"ok := {test}, m := ms[i], s := coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))), lambda x: x.ok), recursive := true)"
            f" FROM (SELECT doc_id, rid, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM rows WHERE regexp_matches(text, '{pattern}')))"
        )
    listed = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place){}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in BASE)
    base = listed.format(" FILTER (WHERE place < 3)")
    return f"WITH rows AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents), hits AS ({' UNION ALL '.join(kinds)}) SELECT r.doc_id, {counts}, sha256({base}) AS base_sha256, {listed.format(' FILTER (WHERE kind IS NOT NULL)')} AS spans FROM rows r LEFT JOIN hits h USING (rid) GROUP BY r.rid, r.doc_id"


SQL = _sql()
