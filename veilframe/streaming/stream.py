"""Streams of documents.

Detection and redaction within a document hold no state, so a streaming
DataFrame goes through the same projection as a table. What lasts over batches
is the vault (written by ``foreachBatch``, read again by the next batch) and exposure by event-time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..operators.detectors import RISK_WEIGHT
from ..operators.tokens import ENTRY
from ..plans.engine import detect, redact, redact_corpus, risk_label, vault

ENTRY_DDL = ", ".join(f.replace(":", " ") for f in ENTRY[len("struct<") : -1].split(","))


def read_text_stream(spark, path: str, schema: str = "doc_id long, text string, ts timestamp", kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def redact_stream(docs: DataFrame, text_col: str = "text", options: Options | None = None) -> DataFrame:
    """The streaming ``docs`` with ``redacted``, ``matches``, ``entries`` and ``error``."""
    return redact(docs, text_col, options)


def exposure_by_window(docs: DataFrame, ts_col: str = "ts", text_col: str = "text", window: str = "10 minutes", late: str = "30 minutes", options: Options | None = None) -> DataFrame:
    """Matches and risk by event-time window and type; events later than ``late`` are dropped by the watermark."""
    found = detect(docs.withWatermark(ts_col, late), text_col, options)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RISK_WEIGHT.items() for x in kv]), F.col("risk")), F.lit(1))
    rows = found.select(F.col(ts_col), F.inline("matches")).withColumn("weight", weight)
    return rows.groupBy(F.window(ts_col, window), "type").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("weight").alias("weight")).select(
        F.col("window.start").alias("window_start"), "type", "occurrences", "weight", risk_label(F.least(F.lit(100), F.col("weight"))).alias("risk_label"))


def write_redacted_stream(
    docs: DataFrame, out: str, vault_out: str, checkpoint: str, id_col: str = "doc_id", options: Options | None = None, once: bool = True,
    scope: str = "corpus",
) -> StreamingQuery:
    """Redacted texts to ``out`` and vault rows to ``vault_out``, a folder for each batch: a batch that is run again replaces its own.

    Scope ``corpus``: a value has one token over all batches. A batch starts from the vault of those before it and writes
    the values that are new. Scope ``document``: numbers begin anew in each document, and vault rows carry its id.
    """

    def batch(df: DataFrame, number: int) -> None:
        if scope == "document":
            done = redact(df, "text", options)
            done.where("error IS NULL").select(id_col, "redacted").write.mode("overwrite").parquet(f"{out}/batch={number}")
            vault(done, id_col).write.mode("overwrite").parquet(f"{vault_out}/batch={number}")
            return
        earlier = df.sparkSession.read.schema(f"{ENTRY_DDL}, batch long").option("basePath", vault_out)
        known = [f"{vault_out}/batch={n}" for n in range(number)]
        seeds = earlier.parquet(*known).drop("batch") if known else None
        done, entries = redact_corpus(df, "text", options, seeds, id_col)
        done.select(id_col, "redacted").write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh = entries if seeds is None else entries.join(seeds.select("type", "value"), ["type", "value"], "left_anti").select(*entries.columns)
        fresh.write.mode("overwrite").parquet(f"{vault_out}/batch={number}")

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
