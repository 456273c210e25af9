"""Operator 2: shards of near-equal bytes by sampled splitters.

Records are ordered by the digest of their text and then of their id, so equal
texts lie together. A size-weighted sample of the keys, whose expected size is
``oversample`` for each range, gives splitters at its quantiles; records are
range-partitioned by them, and ranges that hold too many rows or bytes are
sampled again and subdivided. The sums of all ranges (a row each) give every
record its exact place in the whole order, and the shard is the place of its
middle byte among ``shards`` equal parts. So shards differ by no more than about
one record, and a group of equal texts is cut only where a boundary falls in it.

Cases: a null text has no bytes and the checksum of none; every record counts
``overhead`` bytes besides. Null ids and repeated rows are records of their own;
exact repetitions are in no fixed order among themselves, which shows in no column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def _ranges(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``rows`` with the number of the range that their key falls into."""

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy().astype("S80"), side="right").astype("int32"))

    return rows.withColumn("rng", place("key"))


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, overhead: int = 8,
    ranges_per_shard: int = 16, rows_per_range: int = 1_000_000, oversample: int = 8, seed: int = 5, rounds: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.concat(F.md5(F.coalesce(text, F.lit(""))), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
    )
    # a number of its own ends a key: very many rows equal in id and text are cut like any others
    rows = rows.withColumn("key", F.concat("key", F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")))
    rows = materialise(rows, "shard-keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    want = max(shards * ranges_per_shard, -(-n // rows_per_range))
    u = (F.xxhash64(F.lit(seed), "key").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))
    rate = oversample * want / max(total, 1)
    drawn = rows.where(u < F.col("size") * rate).select("key", "size").orderBy("key").collect()
    weight = np.cumsum([max(r["size"], 1 / rate) for r in drawn]) if drawn else np.zeros(0)
    at = np.searchsorted(weight, np.arange(1, want) * (weight[-1] / want)) if drawn else []
    splitters = np.unique(np.array([drawn[i]["key"] for i in at], "S80"))
    for again in range(rounds):
        held = _ranges(rows, splitters).groupBy("rng").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()
        most_rows, most_bytes = max(rows_per_range, 4 * n // want), 4 * total / want
        over = {r["rng"]: r["rows"] for r in held if r["rows"] > 1 and (r["rows"] > most_rows or r["bytes"] > most_bytes)}
        if not over or again == rounds - 1:
            break
        pick = F.create_map(*[F.lit(x) for k, v in over.items() for x in (k, 4.0 * oversample / v)])
        more = _ranges(rows, splitters).where(u < F.try_element_at(pick, F.col("rng"))).select("key").collect()
        grown = np.unique(np.concatenate([splitters, np.array([r["key"] for r in more], "S80")]))
        if len(grown) == len(splitters):
            break
        splitters = grown
    before_rows, before_bytes, starts = 0, 0, []
    for r in sorted(held, key=lambda r: r["rng"]):
        starts.append((r["rng"], before_rows, before_bytes))
        before_rows, before_bytes = before_rows + r["rows"], before_bytes + r["bytes"]
    # one row for each range: a table of bounded size
    offsets = spark.createDataFrame(starts, "rng int, rows_before long, bytes_before long")
    upto = Window.partitionBy("rng").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        _ranges(rows, splitters)
        .withColumn("nth", F.count(F.lit(1)).over(upto)).withColumn("sum", F.sum("size").over(upto))
        .join(offsets, "rng")
        .select(
            "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth") - 1).alias("place"),
            F.expr(f"cast(least({shards - 1}, ((2 * (bytes_before + sum) - size) * {shards}) div {max(2 * total, 1)}) as int)").alias("shard"),
        )
    )
    placed = materialise(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    # a row for each shard, ``shards`` at most
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> None:
    """Write ``docs`` as Parquet below ``path``, a folder for each shard. Ids must be unique and not null."""
    where = shard(docs, id_col, text_col, shards).select(F.col("doc_id").alias("shard_key"), "shard", "slot")
    docs.join(where, F.col(id_col) == F.col("shard_key")).drop("shard_key").write.mode("overwrite").partitionBy("shard").parquet(path)
