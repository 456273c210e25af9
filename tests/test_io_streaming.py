"""Sources, sinks, streams, the table function and the entry point."""

import json

import pytest
from pyspark.sql import functions as F
from veilframe import udtf
from veilframe.__main__ import main
from veilframe.options import Options
from veilframe.plans import engine
from veilframe.sources import io
from veilframe.streaming import stream


def test_documents_and_vault_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("mail a@x.org\nbye")
    (tmp_path / "in/b.csv").write_text("name,x\nJoe,1\n")
    (tmp_path / "in/c.bin").write_text("a@x.org")
    docs = io.read_documents(spark, str(tmp_path / "in"))
    assert docs.count() == 2
    done = engine.redact(docs, id_col="doc_name")
    io.write_redacted(done, str(tmp_path / "out"), "doc_name")
    io.write_vault(engine.vault(done, "doc_name"), str(tmp_path / "vault"))
    entries = io.read_vault(spark, str(tmp_path / "vault"), "doc_name string")
    back = engine.rehydrate(spark.read.parquet(str(tmp_path / "out")), entries, "redacted", "doc_name")
    assert sorted(r.restored_text for r in back.collect()) == ["mail a@x.org\nbye", "name,x\nJoe,1\n"]
    said = io.vault_json([r.asDict() for r in entries.drop("doc_name", "vault_version", "vault_mode", "vault_style", "vault_created_at").collect()])
    assert len(io.vault_entries(said)) == 2 and json.loads(said)["version"] == 1
    with pytest.raises(ValueError):
        io.vault_entries("[]")
    assert io.read_table(spark, str(tmp_path / "in/b.csv"), "csv").columns == ["name", "x"]


def test_streams(spark, tmp_path):
    rows = [(1, "a@x.org and b@x.org", "2024-01-01T00:01:00"), (2, "nothing", "2024-01-01T00:02:00"), (3, "219-09-9999", "2024-01-01T01:00:00")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string").select("doc_id", "text", F.to_timestamp("t").alias("ts"))
    df.write.json(str(tmp_path / "in"))
    query = stream.write_redacted_stream(stream.read_text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "vault"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {r.doc_id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    token = {r.value: r.token for r in spark.read.parquet(str(tmp_path / "vault")).collect()}
    assert got == {1: f"{token['a@x.org']} and {token['b@x.org']}", 2: "nothing", 3: "[SSN_1]"}
    # the next batch knows the values of the first
    spark.createDataFrame([(4, "b@x.org or c@x.org", None)], "doc_id long, text string, ts timestamp").write.mode("append").json(str(tmp_path / "in"))
    query = stream.write_redacted_stream(stream.read_text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "vault"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    later = {r.doc_id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert later == got | {4: f"{token['b@x.org']} or [EMAIL_3]"}
    assert spark.read.parquet(str(tmp_path / "vault")).count() == 4
    windows = stream.exposure_by_window(stream.read_text_stream(spark, str(tmp_path / "in")).where("ts IS NOT NULL"), options=Options(enabled=("email", "ssn")))
    q = windows.writeStream.outputMode("complete").format("memory").queryName("exposure").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.type, r.occurrences, r.weight) for r in spark.table("exposure").collect()) == [("EMAIL", 2, 14), ("SSN", 1, 12)]


def test_table_function(spark):
    udtf.register(spark)
    got = spark.sql("SELECT value FROM veil_names('Dr. Mary Smith spoke')").collect()
    assert [r.value for r in got] == ["Mary Smith"]
    spark.createDataFrame([(1, "a@x.org, ssn 219-09-9999"), (2, None)], "id int, body string").createOrReplaceTempView("veil_texts")
    got = spark.sql("SELECT id, value, type, d.start FROM veil_texts, LATERAL veil_detect(body) d ORDER BY d.start").collect()
    assert [tuple(r) for r in got] == [(1, "a@x.org", "EMAIL", 0), (1, "219-09-9999", "SSN", 13)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("mail a@x.org")
    assert main([str(tmp_path), "--text", "--vault"]) == 0
    said = capsys.readouterr().out
    assert "[EMAIL_1]" in said and "round trip: unchanged" in said


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
