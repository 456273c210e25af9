"""Operator 5: WARC archives and their merged capture index.

Writing: a record for each page, responses with the page as HTTP payload, and
revisit records (headers only) for pages whose payload equals that of a page with
a larger id. Spark's text writer, with the blank lines that end a record as line
separator, writes the archives to any store; ``archive_bytes`` bounds a file.

Reading: archives come back whole as binary rows, are parsed by Content-Length
and checked against their payload digests. The entries of an archive, sorted by
URL key, timestamp and page, are a run. Runs are cut at sampled splitters, and
every key range is merged from its runs by a loser tree, which gives one global
order of captures: ``(part, place)``.

Cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``;
blanks and controls in a url are percent-coded, so that the blank
that ends a field of a sort key is below all that a field holds; repeated pages are captures of their own.
A page without an id has no ``X-Page`` field and comes first of its url and time;
it revisits the page of largest id with its payload, and is a response where no
page with that payload has an id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: str) -> Column:
    """The SHA-1 of a text's bytes in base 32: five hex digits are four of its letters."""
    bits = "cast(conv(substring(h, 5 * (i div 4) + 1, 5), 16, 10) as int)"
    letter = f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (shiftright({bits}, 15 - 5 * (i % 4)) & 31), 1)"
    return F.expr(f"element_at(transform(array(sha1({payload})), h -> array_join(transform(sequence(0, 31), i -> {letter}), '')), 1)")


def plain_url(url: str) -> Column:
    """A url with its blanks and controls percent-coded."""
    coded = f"array_join(transform(split({url}, ''), c -> if(c <= ' ' or c = '\\u007f', concat('%', lpad(hex(ascii(c)), 2, '0')), c)), '')"
    return F.expr(f"if({url} rlike '[\\\\x00-\\\\x20\\\\x7F]', {coded}, {url})")


_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str) -> str:
    """Sort-friendly form: the host's labels reversed, then path and query, without scheme and fragment."""
    rest = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url).split("#", 1)[0]
    if "://" not in rest:
        return rest
    rest = rest.split("://", 1)[1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, tail = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    labels = ",".join(reversed(name.removeprefix("www.").split(".")))
    return f"{labels}{':' + port if port and port not in ('80', '443') else ''}){tail}"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """The text of each record, without its end, in the column ``value``."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", sha1_base32("html")).withColumn("bytes", F.octet_length("html"))
    keys = materialise(base.select("page_id", "digest", "bytes"), "warc-keys")
    groups = keys.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = keys.join(groups, "digest").where("keeper IS NOT NULL AND NOT page_id <=> keeper").select(
        F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "keeper").distinct()
    copies = materialise(copies, "warc-copies")
    both = base.join(copies, F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest")), "left")
    uid = lambda page: F.regexp_replace(F.md5(F.concat_ws(":", page, "digest")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    revisit = F.col("keeper").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uid(F.col("page_id")), F.lit(">"))),
        line("WARC-Target-URI", plain_url("url")),
        line("WARC-Date", F.date_format(F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(4102444800))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), uid(F.col("keeper")), F.lit(">"))),
            line("X-Refers-To-Page", F.col("keeper")),
        )).otherwise(F.lit("")),
        F.coalesce(line("X-Page", F.col("page_id")), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block)), F.lit("\r\n"),
    )
    return both.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 8 << 20, **columns) -> str:
    """Write the archives below ``path`` and return it."""
    html = F.col(columns.get("html_col", "html")).cast("string")
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(html)), F.lit(0))).first()
    per_file = max(1, archive_bytes * max(n, 1) // (size + 600 * max(n, 1)))
    records(pages, **columns).write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).mode("overwrite").text(path)
    return path


def parse_archive(raw: bytes):
    """(offset, length, fields, block) of each record of an archive."""
    at = 0
    while at < len(raw):
        stop = raw.index(END, at)
        lines = raw[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at offset {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = raw[stop + 4 : stop + 4 + size]
        if len(block) != size or raw[stop + 4 + size : stop + 8 + size] != END:
            raise ValueError(f"the record at offset {at} is cut short")
        yield at, stop + 8 + size - at, fields, block
        at = stop + 8 + size


# ``sort_key`` ends in the place of the record, so no two captures have the same and a range of equal captures can be cut.
ENTRY = (
    "run string, seq int, sort_key string, url_key string, timestamp string, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records, a sorted run for each archive."""

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ENTRY.split(", "))])

    def run(batches):
        for batch in batches:
            for archive, raw in zip(batch["path"], batch["content"], strict=True):
                archive, rows = archive.as_py(), []
                for offset, length, f, block in parse_archive(raw.as_py()):
                    http, _, payload = block.partition(END)
                    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{archive}: payload at offset {offset} doesn't match its digest")
                    stamp = "".join(c for c in f["WARC-Date"] if c.isdigit())
                    key, page = url_key(f["WARC-Target-URI"]), int(f["X-Page"]) if "X-Page" in f else None
                    nth = 0 if page is None else page + (1 << 63)
                    where = f"{zlib.crc32(archive.encode()):08x}{offset:012x}"
                    refers = int(f["X-Refers-To-Page"]) if f["WARC-Type"] == "revisit" else None
                    rows.append((f"{key} {stamp} {nth:020d} {where}", key, stamp, page, f["WARC-Target-URI"], f["WARC-Type"], digest, size, refers, archive, offset, length))
                rows.sort()
                columns = list(zip(*((archive, i, *r) for i, r in enumerate(rows)), strict=True)) or [()] * len(schema)
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, ENTRY)


class LoserTree:
    """Merge of k sorted lists: inner nodes hold the loser of their match, so a step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = [r for r in runs if r], []
        k = self.k = len(self.runs)
        self.at = [0] * k
        self.tree = [-1] * k
        for i in range(k):
            self._play(i)

    def _key(self, i: int):
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._key(i), self._key(j)
        return b is None or (a is not None and (a, i) < (b, j))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k:
            i = self.tree[0]
            if (key := self._key(i)) is None:
                return
            yield i, self.at[i], key
            self.at[i] += 1
            self._play(i)


def merge_index(entries: DataFrame, range_rows: int = 100_000, oversample: int = 8, seed: int = 3) -> DataFrame:
    """``entries`` in one global order by URL key, timestamp and page: with ``part`` (key range), ``place`` in it and
    ``capture``, its place among all. The driver holds ``oversample`` sampled keys and a count for each ``range_rows`` entries."""
    entries = materialise(entries, "warc-runs")
    n = entries.count()
    want = max(1, -(-n // range_rows))
    u = F.xxhash64(F.lit(seed), "sort_key", "archive", "offset").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = sorted(r[0] for r in entries.where(u < oversample * want / max(n, 1)).select("sort_key").collect())
    splitters = np.array(sorted({drawn[len(drawn) * i // want] for i in range(1, want)}) if drawn else [], object)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(object), side="right").astype("int32"))

    def merge(held: pa.Table) -> pa.Table:
        _, run = np.unique(np.array(held["run"].to_pylist(), object), return_inverse=True)
        by_run = np.lexsort((held["seq"].to_numpy(), run))
        rows_of = np.split(by_run, np.flatnonzero(np.diff(run[by_run])) + 1)
        keys = np.array(held["sort_key"].to_pylist(), object)
        tree = LoserTree([keys[r].tolist() for r in rows_of])
        order = np.fromiter((rows_of[i][j] for i, j, _ in tree), np.int64, len(held))
        return held.take(pa.array(order)).append_column("place", pa.array(np.arange(len(held), dtype="int32")))

    dealt = entries.withColumn("part", part("sort_key"))
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    ahead = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(len(splitters) + 1)])])

    def numbered(held: pa.Table) -> pa.Table:
        out = merge(held)
        first = int(ahead[held["part"][0].as_py()])
        return out.append_column("capture", pa.array(np.arange(first, first + len(out), dtype="int64")))

    return dealt.repartition("part").groupBy("part").applyInArrow(numbered, ENTRY + ", part int, place int, capture long")


def archive_pages(pages: DataFrame, path: str | None = None, archive_bytes: int = 8 << 20, **columns) -> DataFrame:
    """Write the archives, read them back and merge their runs: the global capture index."""
    spark = pages.sparkSession
    path = write_archives(pages, path or fresh_path(spark, "warc"), archive_bytes, **columns)
    return merge_index(read_archives(spark, path))
