"""Operator 6: secrets by an incremental blob ledger, in DataFrame functions alone.

Every version of a text is addressed by its SHA-256. A ledger table holds, for
each blob and rule version, the spans found; a run scans only the pairs that the
ledger doesn't have and only one of equal texts, appends what it found, and joins
the ledger back to all paths. A run's findings and its marks of what it has scanned are
one write, and findings are a set when read, so a run that was cut short, or two runs at
once, change no result. Offsets are code points, the end is exclusive.

The gaps between matches (``split``) and the matches themselves
(``regexp_extract_all``) come from the same left-to-right search, so running sums
of their lengths are the offsets. Cases: a null text is an empty blob without
findings; repeated rows and null ids are paths of their own; a very long text is one
blob like any other; an empty table gives an empty result and leaves an empty ledger.
Columns other than the two named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the pattern, a cheap test that every text with a match passes, and the
    shortest value accepted of the group given. A match that fails is dropped, not searched again."""

    kind: str
    pattern: str
    hint: str
    group: int
    least: int
    version: int = 1


# The three base kinds and the added one for key blocks.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob_id string, rule_key string, kind string, spans array<struct<start:int,end:int>>"


def _rule_key(r: Rule) -> str:
    return f"{r.kind}@{r.version}"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (blob_id, text), one for each blob and rule with a finding."""
    per_rule = []
    for n, r in enumerate(rules):
        match = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        # every pair of a gap and the match after it; the last gap has none
        pairs = F.arrays_zip(F.split("text", r.pattern, -1).alias("gap"), match.alias("hit"))
        per_rule.append(F.when(F.col("text").rlike(r.hint), pairs).alias(f"p{n}"))
    found = blobs.select("blob_id", *per_rule)
    hit_any = F.lit(False)
    for n in range(len(rules)):
        hit_any = hit_any | F.col(f"p{n}").isNotNull()
    long = (
        found.where(hit_any)
        .select("blob_id", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"p{n}").alias("pairs")) for n in range(len(rules))])).alias("x"))
        .select("blob_id", "x.rule", F.posexplode("x.pairs").alias("pos", "pair"))
        .select("blob_id", "rule", "pos", F.coalesce(F.length("pair.gap"), F.lit(0)).alias("gap"), F.col("pair.hit").alias("hit"))
        .repartition("blob_id", "rule")
        .dropDuplicates(["blob_id", "rule", "pos"])  # a row that is repeated with its path is scanned again
    )
    upto = Window.partitionBy("blob_id", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = long.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(upto).cast("int"))
    passes: Column = F.lit(None).cast("boolean")
    key, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, r in enumerate(rules):
        own = F.col("rule") == n
        value = F.regexp_extract("hit", r.pattern, r.group) if r.group else F.col("hit")
        passes = F.when(own, F.length(value) >= r.least).otherwise(passes)
        key = F.when(own, F.lit(_rule_key(r))).otherwise(key)
        kind = F.when(own, F.lit(r.kind)).otherwise(kind)
    kept = ends.where(F.col("hit").isNotNull() & passes)
    return kept.groupBy("blob_id", "rule").agg(
        F.array_sort(F.collect_list(F.struct((F.col("end") - F.length("hit")).alias("start"), "end"))).alias("spans")
    ).select("blob_id", key.alias("rule_key"), kind.alias("kind"), "spans")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _owned(versions: DataFrame, path: str) -> DataFrame:
    """(path_id, blob_id, copies of a path and blob) of ``versions`` (path_id, text), as a table."""
    return materialise(versions.select("path_id", F.sha2("text", 256).alias("blob_id")), path)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, blob_id, spans array<struct<kind,ord,start,end>> by start and kind.

    ``ledger`` is a folder that later runs may name again; by default a new one in the shared folder.
    It has a row without spans for every pair scanned (blob_id, rule_key), and one with spans for each with a finding.
    """
    spark = docs.sparkSession
    ledger = (ledger or fresh_path(spark, "secret-ledger")).rstrip("/")
    versions = docs.select(F.col(id_col).alias("path_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    owned = _owned(versions, "secret-paths")
    seen = _read(spark, ledger, LEDGER).where("spans IS NULL").select("blob_id", "rule_key")
    blobs = owned.groupBy("blob_id").agg(F.min("path_id").alias("keeper"), F.count(F.lit(1)).alias("paths"))
    keys = [_rule_key(r) for r in rules]
    known = seen.where(F.col("rule_key").isin(keys)).groupBy("blob_id").agg(F.collect_set("rule_key").alias("done"))
    done = F.coalesce("done", F.array().cast("array<string>"))
    lacking = blobs.join(known, "blob_id", "left").select(
        "blob_id", "keeper", "paths", F.array_except(F.array(*map(F.lit, keys)), done).alias("todo")
    )
    lacking = materialise(lacking, "secret-todo")
    # sets of rules that some blobs lack: one or two as a rule, 2 ** len(rules) at most
    lacks = [[r for r in rules if _rule_key(r) in set(x["todo"])] for x in lacking.select("todo").distinct().collect()]
    fresh = spark.createDataFrame([], LEDGER)
    for todo in sorted((x for x in lacks if x), key=lambda x: [_rule_key(r) for r in x]):
        mine = F.col("todo") == F.array(*[F.lit(_rule_key(r)) for r in todo])
        # rows that aren't to be scanned: further copies of a blob, and blobs that lack other rules
        idle = owned.join(lacking.where((F.col("paths") > 1) | ~mine), "blob_id").where(~mine | ~F.col("path_id").eqNullSafe(F.col("keeper")))
        idle = idle.select(F.col("path_id").alias("idle_id"), F.col("blob_id").alias("idle_blob")).distinct()
        work = versions.withColumn("blob_id", F.sha2("text", 256)).join(
            idle, F.col("path_id").eqNullSafe(F.col("idle_id")) & (F.col("blob_id") == F.col("idle_blob")), "left_anti"
        )
        fresh = fresh.unionByName(scan(work.select("blob_id", "text"), tuple(todo)))
    marks = lacking.select("blob_id", F.explode("todo").alias("rule_key"))
    fresh.unionByName(marks, allowMissingColumns=True).write.mode("append").parquet(ledger)
    order = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)])
    found = (
        spark.read.schema(LEDGER).parquet(ledger)
        .where(F.col("spans").isNotNull() & F.col("rule_key").isin([_rule_key(r) for r in rules]))
        .select("blob_id", "kind", F.explode("spans").alias("s"))
        .groupBy("blob_id")
        .agg(F.array_sort(F.collect_set(F.struct("s.start", order[F.col("kind")].alias("ord"), "kind", "s.end"))).alias("spans"))
    )
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    return owned.join(found, "blob_id", "left").select(F.col("path_id").alias("doc_id"), "blob_id", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op6 from the spans of ``find_secrets``."""
    said = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of a finding replaced by ``mark``; overlapping spans are joined first.

    Paths are matched by (id, blob), so repeated rows are all masked.
    """
    found = find_secrets(docs, id_col, text_col, **options).where(F.size("spans") > 0)
    found = materialise(found.select(F.col("doc_id").alias("hit_id"), F.col("blob_id").alias("hit_blob"), "spans").dropDuplicates(["hit_id", "hit_blob"]), "secret-hits")
    # texts that pass no hint have no finding; only the few others meet the findings
    hinted = F.lit(False)
    for r in options.get("rules", RULES):
        hinted = hinted | F.coalesce(F.col(text_col).rlike(r.hint), F.lit(False))
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    both = docs.where(hinted).join(found, F.col(id_col).eqNullSafe(F.col("hit_id")) & (blob == F.col("hit_blob")), "left")
    # a fold over spans sorted by start: text so far, and the place up to which the source is used
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    text = F.col(text_col)

    def step(acc, s):
        cut = F.when(
            s["start"] >= acc["at"],
            F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))),
        ).otherwise(acc["out"])
        return F.struct(cut.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    masked = F.when(F.col("spans").isNull(), text).otherwise(done)
    return docs.where(~hinted).unionByName(both.select(*[masked.alias(c) if c == text_col else docs[c] for c in docs.columns]))
