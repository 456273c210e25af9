"""Documents from text files and tables, vaults and redacted output to files.

Formats that hold text (md, json, log, yaml, xml, html, sql, eml, rtf, csv, tsv, txt)
are read whole as raw text; tables are read by Spark's own sources.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import ENTRY
from ..options import Options

#: Endings of files that are read as raw text.
TEXT_ENDINGS = ("txt", "md", "csv", "tsv", "json", "log", "yaml", "yml", "xml", "html", "sql", "eml", "rtf")


def read_documents(spark: SparkSession, path: str, endings: tuple[str, ...] = TEXT_ENDINGS) -> DataFrame:
    """(doc_name, text), a row for each file below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_name"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table of documents in any format that Spark reads; CSV is read with its header by default."""
    if kind == "csv":
        options = {"header": "true"} | options
    return spark.read.format(kind).options(**options).load(path)


def write_redacted(redacted: DataFrame, path: str, id_col: str = "doc_id", kind: str = "parquet") -> None:
    """The redacted texts alone: no matches, no vault. Rows that failed are left out and counted by ``error``."""
    redacted.where("error IS NULL").select(id_col, "redacted").write.mode("errorifexists").format(kind).save(path)


def write_vault(entries: DataFrame, path: str, options: Options | None = None) -> None:
    """Vault rows as JSON lines with their header fields. It holds the originals: give the folder narrow rights."""
    opts = (options or Options()).normalised()
    head = {"version": 1, "mode": opts.mode, "style": opts.style, "created_at": datetime.now(UTC).isoformat()}
    entries.select("*", *[F.lit(v).alias(f"vault_{k}") for k, v in head.items()]).write.mode("errorifexists").json(path)


def read_vault(spark: SparkSession, path: str, id_ddl: str = "doc_id long") -> DataFrame:
    fields = ", ".join(f.replace(":", " ") for f in ENTRY[len("struct<") : -1].split(","))
    head = "vault_version int, vault_mode string, vault_style string, vault_created_at string"
    return spark.read.schema(f"{id_ddl}, {fields}, {head}").json(path)


def vault_entries(text: str) -> list[dict]:
    """The entries of one vault in its exchange form: an object with version, mode, style, createdAt and entries."""
    said = json.loads(text)
    if not isinstance(said, dict) or not isinstance(said.get("entries"), list):
        raise ValueError("not a vault")
    return said["entries"]


def vault_json(entries: list[dict], options: Options | None = None) -> str:
    opts = (options or Options()).normalised()
    return json.dumps({"version": 1, "mode": opts.mode, "style": opts.style, "createdAt": datetime.now(UTC).isoformat(), "entries": entries}, ensure_ascii=False)
