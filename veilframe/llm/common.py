"""What the corpus operators share: durable tables, stable hashing, components.

Every intermediate that is read more than once is written as Parquet below the
folder in ``spark.checkpoint.dir``, so a lost executor costs one task's work and
no operator depends on blocks that only one machine holds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One of our own only where none is named and all executors are on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of one Arrow batch at most: whole texts of any length go through Python, so a batch is kept small.
BATCH_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session bounds it more. The setting stays in the session, as results are lazy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialise``, in files by the hash of ``key``: grouping the table by it needs no shuffle."""
    table = f"veilframe_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = fresh_path(df.sparkSession, name)
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.table(table)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete an intermediate when it ends; results are lazy, so nothing knows an earlier time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that reads them is itself written."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            drop_path(table.sparkSession, path)


def hash_order(seed: int, *cols: Column) -> Column:
    """A seeded 64-bit order key of the values, equal on every run."""
    return F.xxhash64(F.lit(seed), *cols)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph: rows (node, component).

    ``edges`` has two long columns u and v; loops and nulls are ignored, and so
    a node without another end isn't listed. ``component`` is the smallest node
    of the component. Alternating large-star and small-star rounds reach a
    forest of stars in O(log^2) rounds; a round is two aggregations and two
    joins that adaptive execution may split, so a node with very many edges
    isn't gathered in one task. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    cur = (
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .distinct()
    )
    path = fresh_path(spark, name)
    cur = materialise(cur, name, path)
    state = None
    while True:
        seen = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = cur.select(F.col("a").alias("n"), F.col("b").alias("o")).union(
            cur.select(F.col("b").alias("n"), F.col("a").alias("o"))
        )
        low = both.groupBy("n").agg(F.least(F.min("o"), F.first("n")).alias("m"))
        large = (
            both.join(low, "n").where("o > n").select(F.col("m").alias("a"), F.col("o").alias("b"))
            .where("a <> b").distinct()
        )
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        nxt = (
            small.where("a <> m").select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"))
            .union(down.select(F.col("m").alias("a"), "b"))
            .distinct()
        )
        new_path = fresh_path(spark, name)
        cur = materialise(nxt, name, new_path)
        drop_path(spark, path)
        path = new_path
    tips = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return tips.union(roots)
