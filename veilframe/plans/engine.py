"""Detection, redaction and restoring as DataFrame plans.

Everything up to the accepted matches is a projection: no row leaves its
partition. Texts go to Python only for names (rows with a capital letter), for
delimited columns (rows whose first line has a fitting heading) and for tokens
(rows with a match). Failing rows fail closed: no text, and what went wrong.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT
from ..functions.patterns import CLOSE, OPEN, SPAN, Shape, empty_spans, literal, rule_spans
from ..operators.delimited import FIRST_LINE, ROOTS, find_cells, label_of
from ..operators.detectors import BY_ID, DEFAULT_ENABLED, RISK_WEIGHT, all_detectors
from ..operators.names import find_names
from ..operators.resolve import MATCH, above, resolve_overlaps, without_allowed
from ..operators.tokens import ENTRY, RESULT, assign, restore, spliced
from ..options import STYLES, Options, Rule

VAULT_VERSION = 1
_NAMES = "array<struct<start:int,end:int,value:string,confidence:double,entity:int,part:string>>"
_TOKENS = "array<struct<token:string,body:string>>"
_CELLS = "array<struct<start:int,end:int,value:string,label:string>>"


def as_text(col: Column) -> Column:
    """Any value as text; null is empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def _match(m: Column, rule: Column, entity: Column | None = None, part: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["confidence"].alias("confidence"), rule["f0"].alias("detector"),
        rule["f1"].alias("priority"), rule["f2"].alias("risk"), rule["f3"].alias("type"),
        (entity if entity is not None else none).cast("int").alias("entity"), (part if part is not None else none).cast("string").alias("part"),
    )


def _rule(detector: str, priority: int, risk: str, kind: str | Column) -> Column:
    """The fields that every match of a detector has."""
    return F.struct(F.lit(detector).alias("f0"), F.lit(priority).alias("f1"), F.lit(risk).alias("f2"), (F.lit(kind) if isinstance(kind, str) else kind).alias("f3"))


def _enriched(found: Column, rule: Column, people: bool = False) -> Column:
    return F.transform(found, lambda m: _match(m, rule, *((m["entity"], m["part"]) if people else ())))


def _names(text: Column, options: Options) -> Column:
    lexicon, aggressive = options.lexicon or DEFAULT, options.aggressive_names
    fields = ("start", "end", "value", "confidence", "entity", "part")

    def one(text: str | None) -> list[dict]:
        try:
            return [dict(zip(fields, n, strict=True)) for n in find_names(text, lexicon, aggressive)]
        except Exception:  # a detector that fails finds nothing; the others go on
            return []

    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    scan.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(scan, _NAMES)(F.when(text.rlike(r"\p{Lu}"), text))


def _cells(text: Column) -> Column:
    def one(text: str | None) -> list[dict]:
        try:
            return [dict(zip(("start", "end", "value", "label"), c, strict=True)) for c in find_cells(text)]
        except Exception:  # as above
            return []

    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    scan.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    header = F.lower(F.substring_index(F.left(text, F.lit(FIRST_LINE + 1)), "\n", 1))
    may = F.lit(False)
    for root in ROOTS:
        may = may | header.contains(root)
    divided = header.contains(",") | header.contains("\t") | header.contains(";")
    return F.pandas_udf(scan, _CELLS)(F.when(divided & may & (F.length(header) <= FIRST_LINE) & text.contains("\n"), text))


def _compiles(df: DataFrame, pattern: str) -> bool:
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:
        return False


def _own_rules(df: DataFrame, rules: Iterable[Rule]) -> list[tuple[Shape, tuple]]:
    """The user's rules as shapes; a rule with an empty or invalid pattern is left out."""
    out = []
    for r in rules:
        raw = str(r.pattern or "").strip()
        pattern = f"(?iu){OPEN}{literal(raw)}{CLOSE}"
        if r.kind == "regex":
            pattern = ("(?i)" if "i" in (r.flags or "") else "") + raw
        if raw and _compiles(df, pattern):
            kind = label_of(r.label or "CUSTOM")
            out.append((Shape(pattern), (f"custom:{kind}", 120, r.risk or "high", kind)))
    return out


def detect(df: DataFrame, text_col: str = "text", options: Options | None = None, matches_col: str = "matches") -> DataFrame:
    """``df`` with the accepted matches of the text: array of disjoint matches by start. Offsets are code points."""
    opts = (options or Options()).normalised()
    enabled = DEFAULT_ENABLED if opts.enabled is None else opts.enabled
    chosen = [d for d in all_detectors() if d.id in enabled or (opts.enabled is None and d.default)]
    lexicon = opts.lexicon or DEFAULT
    rules = [(s, (d.id, d.priority, d.risk, d.type)) for d in chosen for s in d.shapes] + _own_rules(df, opts.custom_rules)
    own = df.withColumn("_vf_text", as_text(F.col(text_col)))
    text = F.col("_vf_text")
    parts = []
    if rules:
        found = rule_spans(text, rules, lexicon.stopwords)
        parts.append(F.call_function("transform", found, F.expr(
            "m -> named_struct('start', m.start, 'end', m.end, 'value', m.value, 'confidence', m.confidence, 'detector', m.rule.f0, "
            "'priority', m.rule.f1, 'risk', m.rule.f2, 'type', m.rule.f3, 'entity', cast(null as int), 'part', cast(null as string))")))
    for d in chosen:
        rule = _rule(d.id, d.priority, d.risk, d.type)
        if d.id == "person_name":
            own = own.withColumn("_vf_names", _names(text, opts))
            parts.append(_enriched(F.coalesce("_vf_names", F.array().cast(_NAMES)), rule, people=True))
        elif d.scan is not None:
            parts.append(_enriched(d.scan(text, lexicon), rule))
    if opts.structure_aware:
        own = own.withColumn("_vf_cells", _cells(text))
        cells = F.transform(F.coalesce("_vf_cells", F.array().cast(_CELLS)), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit(0.95).alias("confidence"), m["label"].alias("label")))
        parts.append(F.transform(cells, lambda m: _match(m, _rule("csv_column", 110, "high", m["label"]))))
    every = F.concat(*parts).cast(f"array<{MATCH}>") if parts else F.array().cast(f"array<{MATCH}>")
    own = own.withColumn("_vf_all", without_allowed(above(every, opts.min_confidence), opts.allowlist))
    return resolve_overlaps(own.select(*[df[c] for c in df.columns if c != matches_col], F.col("_vf_all").alias(matches_col)), matches_col)


def spans_table(detected: DataFrame, id_col: str = "doc_id", matches_col: str = "matches") -> DataFrame:
    """A row for each accepted match."""
    return detected.select(F.col(id_col), F.inline(matches_col))


def _largest(entries: DataFrame) -> dict[str, int]:
    """The number at which each type's tokens of a vault stand: a row for each type."""
    number = F.coalesce(F.try_to_number(F.regexp_extract("body", r"_([0-9]{1,18})(?:_|$)", 1), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))
    return {r[0]: int(r[1]) for r in entries.groupBy("type").agg(F.max(number)).collect()}


def _one_token(entries: DataFrame) -> DataFrame:
    """The entries of a vault, one for each (type, value)."""
    row = F.struct(*[F.col(c) for c in _entry_fields()])
    return entries.groupBy("type", "value").agg(F.min_by(row, F.struct("token", "body")).alias("_vf_row")).select("_vf_row.*")


def _seeds(found: DataFrame, seed_vault: DataFrame, scope: str, id_col: str) -> DataFrame:
    """(_vf_id, _vf_seed): the entries that a document starts with."""
    entry = F.struct(*[F.col(c) for c in _entry_fields()])
    if scope == "document":
        return seed_vault.groupBy(F.col(id_col).alias("_vf_id")).agg(F.collect_list(entry).alias("_vf_seed"))
    values = found.select(F.col(id_col).alias("_vf_id"), F.explode("_vf_matches").alias("_vf_m")).select("_vf_id", "_vf_m.type", "_vf_m.value").distinct()
    return values.join(_one_token(seed_vault), ["type", "value"]).groupBy("_vf_id").agg(F.collect_list(entry).alias("_vf_seed"))


def redact(
    df: DataFrame, text_col: str = "text", options: Options | None = None, seed_vault: DataFrame | None = None, id_col: str = "doc_id",
    seed_scope: str = "document",
) -> DataFrame:
    """``df`` with ``redacted``, ``matches`` (with token and body), ``entries`` (the vault) and ``error``.

    ``seed_vault``: entries of earlier runs (see ``vault``), whose tokens are kept: those of the same ``id_col``, or with the scope
    ``corpus`` those of any document for a value that the text holds again, so that the next document of a person has the
    same token. New tokens go on from the largest number in the vault. For one numbering over documents that are redacted together see ``redact_corpus``.
    """
    opts = (options or Options()).normalised()
    if seed_scope not in ("document", "corpus"):
        raise ValueError(f"no scope {seed_scope}")
    found = detect(df, text_col, opts, "_vf_matches")
    floors: dict[str, int] = {}
    if seed_vault is not None:
        floors = _largest(seed_vault) if seed_scope == "corpus" else {}
        seeds = _seeds(found, seed_vault, seed_scope, id_col)
        found = found.join(seeds, F.col(id_col).eqNullSafe(F.col("_vf_id")), "left").drop("_vf_id")
    else:
        found = found.withColumn("_vf_seed", F.lit(None).cast(f"array<{ENTRY}>"))
    busy = F.size("_vf_matches") > 0
    plain = Options(mode=opts.mode, style=opts.style, salt=opts.salt)

    def run(texts: pd.Series, matches: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found, seed in zip(texts, matches, seeds, strict=True):
            if t is None:
                rows.append((None, None, None, None))
                continue
            try:
                out, entries, tokens = assign(t, [dict(m) for m in found], plain, None if seed is None else [dict(e) for e in seed], floors)
                rows.append((out, entries, [{"token": a, "body": b} for a, b in tokens], None))
            except Exception as e:  # the row fails closed: its text isn't given out
                rows.append((None, [], [], type(e).__name__))
        return pd.DataFrame(rows, columns=["redacted", "entries", "tokens", "error"])

    run.__annotations__ = {"texts": pd.Series, "matches": pd.Series, "seeds": pd.Series, "return": pd.DataFrame}
    text = as_text(F.col(text_col))
    done = found.withColumn("_vf_done", F.pandas_udf(run, RESULT)(F.when(busy, text), F.when(busy, F.col("_vf_matches")), F.when(busy, F.col("_vf_seed"))))
    # zipped, not looked up: a Python function can't stand inside a lambda
    zipped = F.arrays_zip(F.col("_vf_matches").alias("m"), F.coalesce(F.col("_vf_done.tokens"), F.array().cast(_TOKENS)).alias("t"))
    matched = F.transform(zipped, lambda z: z["m"].withField("token", z["t"]["token"]).withField("body", z["t"]["body"]))
    return done.select(
        *[df[c] for c in df.columns if c not in ("redacted", "matches", "entries", "error")],
        F.when(busy, F.col("_vf_done.redacted")).otherwise(text).alias("redacted"), matched.alias("matches"),
        F.when(busy, F.col("_vf_done.entries")).otherwise(F.coalesce("_vf_seed", F.array().cast(f"array<{ENTRY}>"))).alias("entries"),
        F.col("_vf_done.error").alias("error"),
    )


def _entry_fields() -> list[str]:
    return [f.split(":")[0] for f in ENTRY[len("struct<") : -1].split(",")]


def vault(redacted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The vault, a row for each entry. It holds the originals: keep it apart."""
    return redacted.select(F.col(id_col), F.inline("entries"))


def _risk(of: Column) -> Column:
    out = F.lit(1)
    for risk, weight in RISK_WEIGHT.items():
        out = F.when(of == risk, weight).otherwise(out)
    return out


def risk_label(score: Column) -> Column:
    return F.when(score == 0, "Clean").when(score < 15, "Low").when(score < 40, "Moderate").when(score < 70, "High").otherwise("Severe")


def stats(redacted: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each document: occurrences, distinct, by_type, characters, risk_score, risk_label, needs_review."""
    kinds = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["type"])))
    by_type = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter("matches", lambda m: m["type"] == k)))))
    score = F.least(F.lit(100), F.aggregate("matches", F.lit(0), lambda acc, m: acc + _risk(m["risk"])))
    return redacted.select(
        F.col(id_col), F.size("matches").alias("occurrences"), F.size(F.filter("entries", lambda e: e["count"] > 0)).alias("distinct"),
        by_type.alias("by_type"), F.length(as_text(F.col(text_col))).alias("characters"), score.alias("risk_score"), risk_label(score).alias("risk_label"),
        F.size(F.filter("matches", lambda m: m["confidence"] < 1)).alias("needs_review"),
    )


def findings(redacted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each entry in use, with ``place``: the gravest, most frequent first within its document."""
    known = all_detectors()
    label = F.create_map(*[F.lit(x) for d in known for x in (d.id, d.label)])
    group = F.create_map(*[F.lit(x) for d in known for x in (d.id, d.group)])
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RISK_WEIGHT.items() for x in kv]), F.col("e.risk")), F.lit(0))
    sortable = F.array_sort(F.transform(F.filter("entries", lambda e: e["count"] > 0), lambda e, i: F.struct(
        (-_risk(e["risk"])).alias("a"), (-e["count"]).alias("b"), e["type"].alias("c"), i.alias("d"), e.alias("e"))))
    rows = redacted.select(F.col(id_col), F.posexplode(sortable).alias("place", "x")).select(id_col, "place", F.col("x.e").alias("e"))
    return rows.select(
        id_col, "place", "e.type", F.coalesce(F.try_element_at(label, F.col("e.detector")), F.replace("e.type", F.lit("_"), F.lit(" "))).alias("label"),
        F.coalesce(F.try_element_at(group, F.col("e.detector")), F.lit("Custom")).alias("group"), "e.token", "e.value", "e.count", "e.risk", "e.confidence",
        weight.alias("weight"),
    )


def rehydrate(replies: DataFrame, entries: DataFrame, text_col: str = "text", id_col: str = "doc_id", options: Options | None = None) -> DataFrame:
    """``replies`` with ``restored_text``, ``replaced``, ``restored`` and ``missing`` from the vault's rows of the same id."""
    held = entries.groupBy(F.col(id_col).alias("_vf_id")).agg(F.collect_list(F.struct(*[F.col(c) for c in _entry_fields()])).alias("_vf_entries"))
    both = replies.join(held, F.col(id_col).eqNullSafe(F.col("_vf_id")), "left").drop("_vf_id")
    return restore_column(both, text_col, "_vf_entries", options).drop("_vf_entries")


def restore_column(df: DataFrame, text_col: str, entries_col: str, options: Options | None = None) -> DataFrame:
    opts = (options or Options()).normalised()
    mode, style = opts.mode, opts.style
    has = F.coalesce(F.size(entries_col) > 0, F.lit(False))
    schema = (
        "text string, replaced int, restored array<struct<token:string,value:string,type:string,count:int>>, "
        "missing array<struct<token:string,type:string>>"
    )

    def run(texts: pd.Series, entries: pd.Series) -> pd.DataFrame:
        rows = []
        for t, held in zip(texts, entries, strict=True):
            if held is None:
                rows.append((None, 0, [], []))
                continue
            try:
                out, n, found, gone = restore(t, [dict(e) for e in held], mode, style)
            except Exception:  # the row fails closed, as in redaction
                rows.append((None, 0, [], []))
                continue
            rows.append((out, n, [dict(zip(("token", "value", "type", "count"), x, strict=True)) for x in found], [dict(zip(("token", "type"), x, strict=True)) for x in gone]))
        return pd.DataFrame(rows, columns=["text", "replaced", "restored", "missing"])

    run.__annotations__ = {"texts": pd.Series, "entries": pd.Series, "return": pd.DataFrame}
    text = as_text(F.col(text_col))
    done = df.withColumn("_vf_back", F.pandas_udf(run, schema)(F.when(has, text), F.when(has, F.col(entries_col))))
    return done.select(
        *[df[c] for c in df.columns if c not in ("restored_text", "replaced", "restored", "missing")],
        F.when(has, F.col("_vf_back.text")).otherwise(text).alias("restored_text"), F.coalesce("_vf_back.replaced", F.lit(0)).alias("replaced"),
        F.col("_vf_back.restored").alias("restored"), F.col("_vf_back.missing").alias("missing"),
    )


def verify_round_trip(df: DataFrame, text_col: str = "text", options: Options | None = None) -> DataFrame:
    """``df`` with ``redacted``, ``restored_text`` and ``ok``: whether the text came back unchanged."""
    done = redact(df, text_col, options)
    back = restore_column(done, "redacted", "entries", options)
    return back.select(*[df[c] for c in df.columns], "redacted", "restored_text", (F.col("restored_text") == as_text(F.col(text_col))).alias("ok"))


def corpus_tokens(spans_of: DataFrame, buckets: int = 1024, floors: dict[str, int] | None = None) -> DataFrame:
    """One token for each (type, value) of a whole corpus: rows (type, value, token_number).

    Numbers are dense within a type, from its floor on. They come from counts by hash bucket and a row number inside
    a bucket, so a type with most of the values isn't ranked in one task.
    """
    distinct = spans_of.select("type", "value").distinct().withColumn("bucket", F.expr(f"pmod(xxhash64(value), {buckets})"))
    inside = Window.partitionBy("type", "bucket").orderBy("value")
    ahead = Window.partitionBy("type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = distinct.groupBy("type", "bucket").count().withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    numbered = distinct.withColumn("n", F.row_number().over(inside))
    floor = F.lit(0)
    for kind, n in sorted((floors or {}).items()):
        floor = F.when(F.col("type") == kind, F.lit(n)).otherwise(floor)
    return numbered.join(counts.select("type", "bucket", "ahead"), ["type", "bucket"]).select(
        "type", "value", (F.col("ahead") + F.col("n") + floor).cast("long").alias("token_number"))


def redact_corpus(
    df: DataFrame, text_col: str = "text", options: Options | None = None, seed_vault: DataFrame | None = None, id_col: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``redacted``, the vault of the whole corpus): a value has one token in all documents.

    Matches are settled in each document; the distinct values are numbered over all of them, values of ``seed_vault`` keep their
    tokens, and tokens go back to the documents by a join on the value. Numbers begin above those of the
    seeds and of token-like words in the texts. The vault has (token, body, value, type, detector, risk, confidence, count) and holds what this
    call has found. A row without a match is not moved by more than one join on its id and text.
    """
    opts = (options or Options()).normalised()
    found = detect(df.select(F.col(id_col).alias("_vf_id"), as_text(F.col(text_col)).alias("_vf_body")), "_vf_body", opts, "_vf_matches")
    rows = found.where(F.size("_vf_matches") > 0).select(
        "_vf_id", F.sha2("_vf_body", 256).alias("_vf_key"), F.inline("_vf_matches"))
    kinds = rows.select("type").distinct()
    said = df.where(F.col(text_col).cast("string").rlike("_[0-9]")).select(
        F.explode(F.regexp_extract_all(F.upper(as_text(F.col(text_col))), F.lit("(?<![A-Z0-9_])[A-Z][A-Z0-9_]*_[0-9]{1,9}(?![A-Z0-9_])"), F.lit(0))).alias("body"))
    said = said.select(F.regexp_extract("body", "^(.*)_[0-9]+$", 1).alias("type"), "body").join(kinds, "type")
    floors = _largest(said)
    fresh = rows
    if seed_vault is not None:
        held = _one_token(seed_vault)
        for kind, n in _largest(held).items():
            floors[kind] = max(n, floors.get(kind, 0))
        fresh = rows.join(held.select("type", "value"), ["type", "value"], "left_anti")
    left, right = STYLES[opts.style]
    tokens = corpus_tokens(fresh, floors=floors).withColumn("body", F.concat("type", F.lit("_"), "token_number")).select(
        "type", "value", F.concat(F.lit(left), "body", F.lit(right)).alias("token"), "body")
    if seed_vault is not None:
        tokens = tokens.unionByName(held.select("type", "value", "token", "body"))
    placed = rows.join(tokens, ["type", "value"])
    # repeated rows have equal places: a set of them is one row's
    by_doc = placed.groupBy("_vf_id", "_vf_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "token"))).alias("_vf_at"))

    def run(texts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else spliced(t, [(x["start"], x["end"]) for x in a], [x["token"] for x in a]) for t, a in zip(texts, at, strict=True)], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "at": pd.Series, "return": pd.Series}
    text = as_text(F.col(text_col))
    met = df.join(by_doc, F.col(id_col).eqNullSafe(F.col("_vf_id")) & (F.sha2(text, 256) == F.col("_vf_key")), "left")
    done = met.withColumn("_vf_done", F.pandas_udf(run, "string")(F.when(F.col("_vf_at").isNotNull(), text), F.col("_vf_at")))
    out = done.select(*[df[c] for c in df.columns if c != "redacted"], F.when(F.col("_vf_at").isNotNull(), F.col("_vf_done")).otherwise(text).alias("redacted"))
    entries = placed.groupBy("type", "value").agg(
        F.min("token").alias("token"), F.min("body").alias("body"), F.min("detector").alias("detector"), F.min_by("risk", "detector").alias("risk"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).cast("int").alias("count"))
    return out, entries.select(*_entry_fields())


def redact_columns(df: DataFrame, columns: dict[str, str], style: str = "bracket") -> tuple[DataFrame, DataFrame]:
    """A table with each named column's values as tokens of the type given, and the vault of (type, value, token).

    Nulls and blanks stay. A value has one token over all columns of its type.
    """
    long = None
    for c, kind in columns.items():
        part = df.select(F.lit(kind).alias("type"), F.col(c).cast("string").alias("value")).where("value IS NOT NULL AND trim(value) <> ''")
        long = part if long is None else long.unionByName(part)
    left, right = STYLES[style]
    keep = corpus_tokens(long).withColumn("token", F.concat(F.lit(left), "type", F.lit("_"), "token_number", F.lit(right)))
    out = df
    for c, kind in columns.items():
        own = keep.where(F.col("type") == kind).select(F.col("value").alias("_vf_v"), F.col("token").alias("_vf_t"))
        out = out.join(own, F.col(c).cast("string") == F.col("_vf_v"), "left").withColumn(c, F.coalesce("_vf_t", F.col(c).cast("string"))).drop("_vf_v", "_vf_t")
    return out.select(*df.columns), keep


__all__ = [
    "BY_ID", "DEFAULT_ENABLED", "SPAN", "VAULT_VERSION", "as_text", "corpus_tokens", "detect", "empty_spans", "findings", "redact", "redact_columns", "redact_corpus",
    "rehydrate", "restore_column", "risk_label", "spans_table", "stats", "vault", "verify_round_trip",
]
