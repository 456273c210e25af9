"""Detectors, overlap, names, columns, tokens and restoring, on text of our own."""

import random
import time

import pytest
from pyspark.sql import functions as F
from veilframe.functions import validators as V
from veilframe.functions.lexicon import DEFAULT
from veilframe.functions.patterns import Shape, trim_trailing
from veilframe.operators.delimited import cells_of, find_cells
from veilframe.operators.detectors import DEFAULT_ENABLED, DETECTORS, Detector, detect_column, register_detector
from veilframe.operators.names import find_names
from veilframe.operators.resolve import MATCH, overlapping, resolve_overlaps
from veilframe.operators.tokens import assign, hash32, restore
from veilframe.plans import queries
from veilframe.options import Options, Rule
from veilframe.plans import engine, queries
from veilframe.plans.cases import CLEAN, DETECTOR_CASES

def test_every_detector_has_a_case():
    assert {d.id for d in DETECTORS} == {d for d, _, _ in DETECTOR_CASES}
    assert len(DETECTORS) == 41 and len(DEFAULT_ENABLED) == 37


def test_detectors_find_and_place(spark):
    """Each shape apart, without the settling of overlaps: every value named is found where its text has it."""
    cases = [(n, *c) for n, c in enumerate(DETECTOR_CASES) if c[0] != "person_name"]
    df = spark.createDataFrame([(n, t) for n, _, t, _ in cases] + [(-1, None), (-2, ""), (-3, "No such thing is here at all.")], "n int, text string")
    ids = sorted({d for _, d, _, _ in cases})
    rows = {r.n: r for r in df.select("n", "text", *[detect_column(F.col("text"), i).alias(i) for i in ids]).collect()}
    for n, detector, text, want in cases:
        got = rows[n][detector]
        assert all(text[s.start : s.end] == s.value for s in got), detector
        assert set(want) <= {s.value for s in got}, (detector, got)
    assert not any(rows[n][i] for n in (-1, -2, -3) for i in ids)


def long_texts():
    return {
        "dotted run": "x@" + "a." * 500_000 + "com", "letters and an at": "a" * 500_000 + "@" + "b" * 500_000, "mails": "a@b.io " * 100_000,
        "digits": "1 " * 500_000, "numbers after a hint": "account 1234567 " * 60_000, "urls in a run": "http://a" * 100_000,
        "points": "http://a" + "." * 1_000_000, "labels": "policy no " * 100_000, "hosts": "a-" * 500_000, "names": "Mary Smith " * 90_000,
        "plus signs": "+1(" * 300_000, "key heads": "-----BEGIN PRIVATE KEY-----" * 30_000, "hex pairs": "ab:" * 300_000,
    }


def test_no_text_is_too_long(spark):
    """Texts of a million characters made to trip patterns: all come back, in time that grows with their length."""
    df = spark.createDataFrame(list(enumerate(long_texts().values())), "doc_id int, text string").repartition(8)
    began = time.time()
    rows = engine.verify_round_trip(df, options=Options(enabled=tuple(d.id for d in DETECTORS))).select("doc_id", "ok").collect()
    assert len(rows) == len(long_texts()) and all(r.ok for r in rows)
    assert time.time() - began < 150


def test_many_overlaps_in_one_text(spark):
    text = "joe@x.org " * 20_000
    rules = (Rule("domain", "x.org"), Rule("half", "joe@", "regex"))
    began = time.time()
    row = engine.detect(spark.createDataFrame([(1, text)], "doc_id int, text string"), options=Options(enabled=("email",), structure_aware=False, custom_rules=rules)).first()
    assert len(row.matches) == 40_000 and time.time() - began < 60


def test_validator_vectors(spark):
    got = {(r.fn, r.input): r.valid for r in queries.validator_vectors(spark, "").collect()}
    assert got == {(f, i): x for f, i, x in queries.VECTORS}
    none = spark.range(1).select(*[f(F.lit(None).cast("string")).alias(n) for n, f in V.VALIDATORS.items()]).first()
    assert not any(none)


def test_valid_date_and_hash(spark):
    rows = [(2024, 2, 29, True), (2023, 2, 29, False), (1899, 1, 1, False), (2000, 13, 1, False), (2000, 4, 31, False), (None, 1, 1, False)]
    df = spark.createDataFrame(rows, "y int, m int, d int, ok boolean")
    assert df.where(V.valid_date(F.col("y"), F.col("m"), F.col("d")) != F.col("ok")).count() == 0
    words = ["", "a", "foobar", "é😀"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(V.hash32(F.col("w"))).collect()]
    assert got == [hash32(w) for w in words] and hash32("foobar") == 0xBF9CF968


def plain_trim(v):
    while v and v[-1] in ".,;:!?'\"»)]}":
        if v[-1] == ")" and v.count("(") >= v.count(")"):
            break
        v = v[:-1]
    return v


def test_trim_trailing(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("a().,]») ") for _ in range(rng.randrange(12))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(trim_trailing(F.col("v"))).collect()]
    assert got == [plain_trim(v) for v in values]


def test_resolve_overlaps(spark):
    rng = random.Random(5)
    rows, want = [], []
    for n in range(60):
        found = []
        for _ in range(rng.randrange(14)):
            s = rng.randrange(30)
            found.append((s, s + rng.randrange(1, 9), "v", rng.choice([0.5, 1.0]), "d", rng.randrange(3), "low", "T", None, None))
        kept = []
        for m in sorted(found, key=lambda m: (-m[5], m[0] - m[1], -m[3], m[0])):
            if all(m[1] <= k[0] or k[1] <= m[0] for k in kept):
                kept.append(m)
        rows.append((n, found))
        want.append(sorted(k[:2] for k in kept))
    df = spark.createDataFrame(rows, f"n int, m array<{MATCH}>")
    got = resolve_overlaps(df, "m").orderBy("n").collect()
    assert [[(x.start, x.end) for x in r.m] for r in got] == want
    busy = df.orderBy("n").select(overlapping(F.col("m")).alias("o")).collect()
    assert [r.o for r in busy] == [len(w) < len(f[1]) for w, f in zip(want, rows, strict=True)]


def test_names():
    names = lambda t, **o: [(v, e, p) for _, _, v, _, e, p in find_names(t, DEFAULT, **o)]
    assert names("Dr. Sarah Whitfield met James van Berg. Later Whitfield and James left.") == [
        ("Sarah Whitfield", 1, "full"), ("James van Berg", 2, "full"), ("Whitfield", 1, "last"), ("James", 2, "first")]
    assert names("Name: Zorblax\nThe Quarterly Report Is Ready") == [("Zorblax", 1, "first")]
    assert names("Best regards,\nQuill Harrow") == [("Quill Harrow", 1, "full")]
    assert names("will may mark this. The Grant was given. NASA AND FBI") == []
    assert names("") == [] and names(None) == []
    assert names("Sarah went home") == [] and names("Sarah went home", aggressive=True) == [("Sarah", 1, "first")]
    text = "é😀 Mary  Smith (Bob Jones)"
    assert all(text[s:e] == v for s, e, v, *_ in find_names(text, DEFAULT))


def test_many_people_keep_their_numbers(spark):
    given = sorted(DEFAULT.given - DEFAULT.stopwords - DEFAULT.surnames)[:12]
    text = "\n".join(f"Name: {g.capitalize()} Zed{chr(97 + i)}" for i, g in enumerate(given))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    row = engine.verify_round_trip(df).first()
    assert row.ok and "[PERSON_1]" in row.redacted and "[PERSON_12]" in row.redacted


def test_cells():
    assert cells_of('a,"b,c",d', ",") == [(0, "a"), (2, '"b,c"'), (8, "d")]
    text = 'id;E-mail;notes\n1;joe at home;x\n2;n/a;y\n\n3;"ann; b";z\n4\n'
    got = find_cells(text)
    assert [(v, lab) for _, _, v, lab in got] == [("joe at home", "E_MAIL"), ("ann; b", "E_MAIL")]
    assert all(text[s:e] == v for s, e, v, _ in got)
    assert find_cells("no delimiter\nhere") == find_cells("name\nx") == find_cells(None) == find_cells("a,b\n1,2") == []


CORPUS = [
    "From: Priya Patel <priya.patel@acme.example>\nTo: Accounts\n\nPlease pay GB82 WEST 1234 5698 7654 32 by Friday.\nBest regards,\nPriya Patel\n",
    "name,email,amount\nJoe Stone,joe@x.org,12\n,,\n\"Ann, B\",ann@x.org,9\n",
    "# Notes\n\n- call **+1 (415) 555-0134**\n- card `4111 1111 1111 1111` exp 04/27\n",
    "Ünïcode 😀 père, pere@example.fr — SSN 219-09-9999 naïve 10.1.2.30", "", " ", "[EMAIL_1] a@b.io [email_2] PERSON_1 and Mr. Jack Stone",
    "token = abcdefgh1 token = abcdefgh1 token = other-one1", "$1 \\ $0 a@b.io \\1",
]


@pytest.mark.parametrize("mode", ["token", "pseudonym"])
@pytest.mark.parametrize("style", ["bracket", "curly", "angle", "bare"])
def test_round_trip(spark, mode, style):
    df = spark.createDataFrame(list(enumerate([*CORPUS, None])), "doc_id int, text string")
    got = engine.verify_round_trip(df, options=Options(mode=mode, style=style)).collect()
    assert all(r.ok for r in got)
    assert "a@b.io" not in "".join(r.redacted for r in got) and "4111 1111 1111 1111" not in next(r for r in got if r.doc_id == 2).redacted


def test_everything_on(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id int, text string")
    every = Options(enabled=tuple(d.id for d in DETECTORS), aggressive_names=True)
    assert engine.verify_round_trip(df, options=every).where("NOT ok").count() == 0


def test_clean_text_stays(spark):
    done = engine.redact(spark.createDataFrame(list(enumerate(CLEAN)), "doc_id int, text string"))
    assert [r.redacted for r in done.orderBy("doc_id").collect()] == list(CLEAN)
    assert {r.risk_label for r in engine.stats(done).collect()} == {"Clean"}


def test_replies_restore_in_any_dress(spark):
    df = spark.createDataFrame([(1, "Mail joe@x.org or ann@x.org.")], "doc_id int, text string")
    done = engine.redact(df, options=Options(enabled=("email",)))
    entries = engine.vault(done)
    replies = ["**[EMAIL_1]** and `[email_2]`", "- EMAIL_1\n- [ EMAIL_2 ]", "only [EMAIL_1]", "EMAIL_12 xEMAIL_1"]
    for text, want, n in zip(replies, ["**joe@x.org** and `ann@x.org`", "- joe@x.org\n- ann@x.org", "only joe@x.org", replies[3]], [2, 2, 1, 0], strict=True):
        row = engine.rehydrate(spark.createDataFrame([(1, text)], "doc_id int, text string"), entries).first()
        assert (row.restored_text, row.replaced) == (want, n)
        assert len(row.restored) + len(row.missing) == 2
    other = engine.rehydrate(spark.createDataFrame([(2, "[EMAIL_1]"), (None, None)], "doc_id int, text string"), entries).collect()
    assert {r.restored_text for r in other} == {"[EMAIL_1]", ""}


def test_values_put_back_are_not_searched_again():
    entries = [{"token": "[A_1]", "body": "A_1", "value": "x [B_1] y", "type": "A"}, {"token": "[B_1]", "body": "B_1", "value": "z", "type": "B"}]
    assert restore("[A_1] [B_1]", entries, "token", "bracket")[0] == "x [B_1] y z"
    assert restore("<A_1>", entries, "token", "bare")[0] == "<x [B_1] y>"


def test_seed_vault_keeps_tokens(spark):
    first = engine.redact(spark.createDataFrame([(1, "a@x.org b@x.org")], "doc_id int, text string"), options=Options(enabled=("email",)))
    second = engine.redact(spark.createDataFrame([(1, "c@x.org b@x.org")], "doc_id int, text string"), options=Options(enabled=("email",)), seed_vault=engine.vault(first))
    assert second.first().redacted == "[EMAIL_3] [EMAIL_2]"


def test_custom_rules_allowlist_confidence(spark):
    df = spark.createDataFrame([(1, "Project Kingfisher, kingfisher x; Ref AB-12 mail a@acme.com")], "doc_id int, text string")
    values = lambda **o: [m.value for m in engine.detect(df, options=Options(**o)).first().matches]
    assert values(enabled=(), custom_rules=(Rule("bird", "KINGFISHER"),)) == ["Kingfisher", "kingfisher"]
    assert values(enabled=(), custom_rules=(Rule("r", "ab-[0-9]+", "regex", "i"), Rule("bad", "(", "regex"), Rule("none", " "))) == ["AB-12"]
    assert values(enabled=("email",), allowlist=("ACME",)) == [] and values(enabled=("email",), allowlist=("ac",)) == ["a@acme.com"]
    assert values(enabled=("social_handle", "email"), min_confidence=0.9) == ["a@acme.com"]
    assert values(enabled=()) == []
    assert engine.redact(df, options=Options(enabled=(), custom_rules=(Rule("my bird!", "kingfisher"),))).first().redacted.startswith("Project [MY_BIRD_1]")


def test_options_are_made_safe():
    o = Options(mode="x", style="y", allowlist=(" a ", "")).normalised()
    assert (o.mode, o.style, o.allowlist) == ("token", "bracket", ("a",))


def test_stats_and_findings(spark):
    df = spark.createDataFrame([(1, "SSN 219-09-9999, a@x.org, (415) 555-2671, a@x.org")], "doc_id int, text string")
    done = engine.redact(df)
    s = engine.stats(done).first()
    assert (s.occurrences, s["distinct"], s.risk_score, s.risk_label, s.characters) == (4, 3, 33, "Moderate", 49)
    assert [(f.type, f["count"]) for f in engine.findings(done).orderBy("place").collect()] == [("SSN", 1), ("EMAIL", 2), ("PHONE", 1)]


def test_non_text_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 42), (2, None)], "doc_id int, text int")
    assert [r.redacted for r in engine.redact(df).orderBy("doc_id").collect()] == ["42", ""]
    assert engine.redact(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a@x.org", 1, 2, 3)], "doc_id int, text string, matches int, redacted int, entries int")
    assert engine.redact(clash).first().redacted == "[EMAIL_1]"


def test_failing_rows_fail_closed(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a@x.org")], "doc_id int, text string")
    seed = spark.createDataFrame([(1, "[EMAIL_1]", None, "a@y.org", "EMAIL", "email", "high", 1.0, 1)], "doc_id int, token string, body string, value string, type string, detector string, risk string, confidence double, count int")
    row = engine.redact(df, seed_vault=seed).first()
    assert row.redacted is None and row.error


def test_redact_columns(spark):
    df = spark.createDataFrame([(i, f"p{i % 7}", None if i % 3 else f"p{i % 5}") for i in range(60)], "id int, a string, b string")
    masked, keep = engine.redact_columns(df, {"a": "PERSON", "b": "PERSON"})
    back = {r.token: r.value for r in keep.collect()}
    got = {r.id: (back.get(r.a), back.get(r.b)) for r in masked.collect()}
    assert got == {r.id: (r.a, r.b) for r in df.collect()}
    assert sorted(r.token_number for r in keep.collect()) == list(range(1, 8))


def test_registered_detector(spark):
    register_detector(Detector("shelf_mark", "Shelf mark", "Library", 99, "low", False, lambda t, lex: detect_column(t, "vin", lex)))
    register_detector(Detector("locker", "Locker", "Library", 98, "low", False, shapes=(Shape("L-[0-9]{3}", needs=("l-",)),)))
    df = spark.createDataFrame([(1, "1M8GDM9AXKP042788 in L-204")], "doc_id int, text string")
    assert [m.type for m in engine.detect(df, options=Options(enabled=("shelf_mark", "locker"))).first().matches] == ["SHELF_MARK", "LOCKER"]
    for wrong in (DETECTORS[0], Detector("empty", "Empty", "Library", 1, "low", False)):
        with pytest.raises(ValueError):
            register_detector(wrong)


def test_a_failing_detector_stops_no_other(spark, monkeypatch):
    def broken(text, lexicon, aggressive):
        raise RuntimeError

    monkeypatch.setattr(engine, "find_names", broken)
    monkeypatch.setattr(engine, "find_cells", broken)
    df = spark.createDataFrame([(1, "name,mail\nMary Smith,a@x.org")], "doc_id int, text string")
    assert [m.type for m in engine.detect(df).first().matches] == ["EMAIL"]


def test_next_documents_keep_tokens(spark):
    opts = Options(enabled=("email",), structure_aware=False)
    first = engine.redact(spark.createDataFrame([(1, "a@x.org b@x.org")], "doc_id int, text string"), options=opts)
    later = spark.createDataFrame([(2, "c@x.org b@x.org"), (3, "a@x.org"), (4, "none")], "doc_id int, text string")
    done = engine.redact(later, options=opts, seed_vault=engine.vault(first), seed_scope="corpus")
    assert {r.doc_id: r.redacted for r in done.collect()} == {2: "[EMAIL_3] [EMAIL_2]", 3: "[EMAIL_1]", 4: "none"}
    with pytest.raises(ValueError):
        engine.redact(later, seed_scope="all")


def test_one_token_over_a_corpus(spark):
    opts = Options(enabled=("email", "ssn"), structure_aware=False)
    rows = [(1, "a@x.org b@x.org"), (2, "b@x.org 219-09-9999"), (2, "b@x.org 219-09-9999"), (None, "a@x.org EMAIL_7"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    done, entries = engine.redact_corpus(df, options=opts)
    token = {r.value: r.token for r in entries.collect()}
    assert sorted(token) == ["219-09-9999", "a@x.org", "b@x.org"] and token["219-09-9999"] == "[SSN_1]"
    assert {token["a@x.org"], token["b@x.org"]} == {"[EMAIL_8]", "[EMAIL_9]"}  # 7 stands in a text

    def masked(text):
        for value, t in token.items():
            text = (text or "").replace(value, t)
        return text

    assert sorted((r.redacted for r in done.collect())) == sorted(masked(t) for _, t in rows)
    again, more = engine.redact_corpus(spark.createDataFrame([(9, "b@x.org z@x.org")], "doc_id int, text string"), options=opts, seed_vault=entries)
    assert again.first().redacted == f"{token['b@x.org']} [EMAIL_10]"
    assert engine.redact_corpus(df.limit(0), options=opts)[0].count() == 0


def test_assign_avoids_tokens_in_the_text():
    m = {"start": 8, "end": 14, "value": "a@x.io", "confidence": 1.0, "detector": "email", "risk": "high", "type": "EMAIL", "entity": None, "part": None}
    assert assign("email_1 a@x.io", [m], Options())[0] == "email_1 [EMAIL_2]"


def test_exposure_counts_every_address(spark, tmp_path):
    rows = [(100 * s + i, f"s{s}" if s else None, " ".join(f"a{s}x{i}x{j}@x.org" for j in range(i % 3 * 10))) for s in range(12) for i in range(60)]
    spark.createDataFrame(rows, "doc_id int, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: (r.addresses, r.median_hits) for r in queries.approximate_exposure(spark, f"file://{tmp_path}").collect()}
    assert got == {f"s{s}" if s else None: (600, 20) for s in range(12)}


@pytest.mark.parametrize("text,value", [
    ("at +1 (608) 555-2280 37.92.178.161 in", "+1 (608) 555-2280"),
    ("at +1 (608) 555-2280 37.92.1.5 in", "+1 (608) 555-2280"),
    ("at +1 608 555 2280 4078918989542222", "+1 608 555 2280"),
    ("at +44 20 7946 0958 37.92.178.161.", "+44 20 7946 0958"),
    ("at +33 1.23.45.67.89 or", "+33 1.23.45.67.89"),
    ("at +49 30 1234 5678 9012 345 6789", "+49 30 1234 5678"),
])
def test_a_telephone_ends_before_what_follows_it(spark, text, value):
    found = spark.createDataFrame([(text,)], "t string").select(detect_column(F.col("t"), "phone").alias("m")).first().m
    assert value in [m.value for m in found] and not any(len(m.value) > len(value) for m in found)
