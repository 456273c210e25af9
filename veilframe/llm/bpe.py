"""Operator 3: byte-level BPE of whole texts by overlapping chunks.

A text of at most ``chunk`` characters is encoded where it is read. A longer one
is cut into chunks that overlap by ``overlap`` characters on each side; the
chunks are pre-tokenised apart, on whatever executors are free. The pattern looks
at nothing before a match, so where the pre-token boundaries of two neighbours
first agree they agree from there on: that is the seam. The text between two
seams is encoded, and the ids are joined in order. A chunk that shares no
boundary with its neighbour (one long run of letters, say) is joined to it and
encoded with it, so the ids are those of the undivided text in every case.
Decoding concatenates the bytes of the ids.

Cases: a null text counts as empty and gives no ids; repeated rows and null ids
are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Characters that may follow a match and still change it: a contraction's letters.
MARGIN = 4


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def splitter():
    return regex.compile(public_tokenizers.PATTERN)


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of one text. Runs too long for the library's own splitter are split here."""
    try:
        return enc.encode_ordinary(text)
    except BaseException as e:  # the library's panic isn't an Exception
        if type(e).__name__ != "PanicException":
            raise
    out: list[int] = []
    for m in splitter().finditer(text):
        out += enc._encode_single_piece(m.group())
    return out


def boundaries(text: str, last: bool) -> np.ndarray:
    """Ends of the pre-tokens of a chunk that hold whatever follows it."""
    ends = np.fromiter((m.end() for m in splitter().finditer(text)), np.int64)
    return ends if last else ends[ends <= len(text) - MARGIN]


def seams(chunks: list[tuple[int, np.ndarray]]) -> list[int | None]:
    """For chunks (start, boundaries), in order: the first boundary that each shares with
    the one before it, None where there is none. Positions are those of the text."""
    out: list[int | None] = [0]
    for (_, before), (_, own) in zip(chunks, chunks[1:], strict=False):
        both = np.intersect1d(before, own, assume_unique=True)
        out.append(int(both[0]) if len(both) else None)
    return out


def _digests(enc: tiktoken.Encoding, ids: list[int]) -> tuple[int, str, str]:
    said = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return len(ids), said, hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


def encode_documents(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = 8192, overlap: int = 256, with_ids: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256,
    and with ``with_ids`` the ids themselves (array<int>)."""
    if chunk <= 2 * overlap or overlap <= MARGIN:
        raise ValueError("chunk must exceed two overlaps, and overlap the margin")
    key_type = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        out += ", ids array<int>"
    src = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )

    def finished(ids_of: list[tuple[object, list[int]]]) -> pd.DataFrame:
        enc = encoder(ranks_path)
        rows = [(d, *_digests(enc, ids), *([ids] if with_ids else [])) for d, ids in ids_of]
        cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
        return pd.DataFrame(rows, columns=cols).astype({"doc_id": object})

    def short(batches):
        enc = encoder(ranks_path)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                yield finished([(None if pd.isna(d) else d, encode_text(enc, t)) for d, t in zip(part["doc_id"], part["t"], strict=True)])

    brief = src.where(F.length("t") <= chunk).mapInPandas(short, out)
    return brief.unionByName(_encode_long(src.where(F.length("t") > chunk), ranks_path, key_type, chunk, overlap, finished, out))


def packed(ids: np.ndarray) -> bytes:
    """Ids as compressed bytes, two of each where they fit."""
    small = not len(ids) or ids.max() < 1 << 16
    return (b"2" if small else b"4") + zlib.compress(ids.astype("<u2" if small else "<i4").tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), "<u2" if blob[:1] == b"2" else "<i4").astype(np.int64)


def _encode_long(src, ranks_path, key_type, chunk, overlap, finished, out) -> DataFrame:
    """The chunked way, for the rows of ``src``; the chunks are a table in the shared folder."""
    cut = (
        src.withColumn("rid", F.monotonically_increasing_id())
        .withColumn("n", F.ceil(F.length("t") / chunk).cast("int"))
        .select("rid", "doc_id", "n", "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        .withColumn("at", F.col("k").cast("long") * chunk)
        .withColumn("lo", F.greatest(F.col("at") - overlap, F.lit(0)))
        .select(
            "rid", "doc_id", "k", "n", "at", "lo",
            F.expr(f"substring(t, cast(lo + 1 as int), cast(at - lo + {chunk + overlap} as int))").alias("part"),
        )
    )
    cut = materialise(cut, "bpe-chunks")

    def encode_chunk(enc, r) -> tuple:
        """Ids from the first boundary where the chunk meets the one before it up to its seam with the next, which it finds
        itself, as its text holds all that the next one's first boundaries come from; how many ids stand before each of the first
        boundaries tells what the chunk before has encoded already."""
        ends = boundaries(r.part, r.k == r.n - 1) + r.lo
        first = ends[ends <= r.at + overlap] if r.k else np.zeros(1, np.int64)
        seam = r.lo + len(r.part)
        if r.k < r.n - 1:
            nxt = r.at + chunk - overlap
            met = np.intersect1d(ends, boundaries(r.part[nxt - r.lo :], False) + nxt, assume_unique=True)
            seam = int(met[0]) if len(met) else -1
        if seam < 0 or not len(first):
            return r.rid, r.doc_id, r.k, -1, b"", b"", b""
        ids, ahead = [], []
        for x, y in zip(first, [*first[1:], seam], strict=True):
            ahead.append(len(ids))
            ids += encode_text(enc, r.part[x - r.lo : y - r.lo]) if y > x else []
        return r.rid, r.doc_id, r.k, seam, first.astype("<i8").tobytes(), np.array(ahead, "<i8").tobytes(), packed(np.asarray(ids, "<i4"))

    def chunks(batches):
        enc = encoder(ranks_path)
        for pdf in batches:
            rows = [encode_chunk(enc, r) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["rid", "doc_id", "k", "seam", "first", "ahead", "ids"]).astype({"doc_id": object})

    schema = f"rid long, doc_id {key_type}, k int, seam long, first binary, ahead binary, ids binary"
    held = materialise(cut.mapInPandas(chunks, schema), "bpe-ids")

    def stitched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        out, start = [], 0
        for seam, first, ahead, ids in zip(pdf["seam"], pdf["first"], pdf["ahead"], pdf["ids"], strict=True):
            at = np.searchsorted(np.frombuffer(first, "<i8"), start)
            out.append(unpacked(ids)[np.frombuffer(ahead, "<i8")[at] :])
            start = seam
        doc = pdf["doc_id"].iloc[0]
        return finished([(None if pd.isna(doc) else doc, np.concatenate(out).tolist())])

    apart = materialise(held.where("seam < 0").select("rid").distinct(), "bpe-unseamed")
    done = held.join(apart, "rid", "left_anti").groupBy("rid").applyInPandas(stitched, out)
    return done.unionByName(_encode_unseamed(cut.join(apart, "rid", "left_semi"), ranks_path, key_type, chunk, overlap, finished, out))


def _encode_unseamed(cut, ranks_path, key_type, chunk, overlap, finished, out) -> DataFrame:
    """The few texts of which two neighbours share no boundary: chunks are joined up to the next seam and encoded with it."""

    def marks(batches):
        """Boundaries of each chunk where it meets its neighbours."""
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ends = boundaries(r.part, r.k == r.n - 1) + r.lo
                near = (ends <= r.at + overlap) | (ends >= r.at + chunk - overlap)
                rows.append((r.rid, r.k, r.at, ends[near].astype("<i8").tobytes()))
            yield pd.DataFrame(rows, columns=["rid", "k", "at", "ends"])

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        every = [(int(a), np.frombuffer(e, "<i8")) for a, e in zip(pdf["at"], pdf["ends"], strict=True)]
        found = seams(every)
        starts = [a if s is None else s for (a, _), s in zip(every, found, strict=True)]
        head, heads = 0, []
        for k, s in enumerate(found):
            head = k if s is not None else head
            heads.append(head)
        ends = [*starts[1:], -1]
        _, place, times = np.unique(heads, return_inverse=True, return_counts=True)
        return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "k": pdf["k"].to_numpy(), "head": heads, "from": starts, "to": ends, "alone": times[place] == 1})

    met = cut.mapInPandas(marks, "rid long, k int, at long, ends binary")  # the table's rows are dealt already; no text is moved
    plan = materialise(met.groupBy("rid").applyInPandas(stitch, "rid long, k int, head int, from long, to long, alone boolean"), "bpe-plan")
    cuts = cut.join(plan, ["rid", "k"]).select(
        "rid", "doc_id", "head", "k", "alone", F.expr("substring(part, cast(from - lo + 1 as int), cast(if(to < 0, length(part), to - from) as int))").alias("piece"))
    runs = (  # chunks without a seam between them: the only texts that are moved
        cuts.where("NOT alone").groupBy("rid", "doc_id", "head")
        .agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("run"))
        .select("rid", "doc_id", "head", F.expr("array_join(transform(run, x -> x.piece), '')").alias("piece"))
    )
    pieces = cuts.where("alone").select("rid", "doc_id", "head", "piece").unionByName(runs)

    def encode(batches):
        enc = encoder(ranks_path)
        for pdf in batches:
            ids = [packed(np.asarray(encode_text(enc, t), "<i4")) for t in pdf["piece"]]
            yield pd.DataFrame({"rid": pdf["rid"], "doc_id": pdf["doc_id"].astype(object), "head": pdf["head"], "ids": ids})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("head")
        doc = pdf["doc_id"].iloc[0]
        return finished([(None if pd.isna(doc) else doc, np.concatenate([unpacked(b) for b in pdf["ids"]]).tolist())])

    done = pieces.mapInPandas(encode, f"rid long, doc_id {key_type}, head int, ids binary")
    return done.groupBy("rid").applyInPandas(join, out)


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the bytes of its ids; null ids give null."""

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        enc = encoder(ranks_path)
        return ids.map(lambda x: None if x is None else enc.decode_bytes([int(i) for i in x]))

    return encoded.withColumn("decoded", decoded(F.col(ids_col)))
