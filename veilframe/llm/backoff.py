"""Operator 4: stupid-backoff language-model scores against the corpus itself.

S(w | h) is count(hw) / count(h) if the n-gram hw occurs at least ``min_count``
times in the corpus, else ``alpha`` times S with the history shortened by its
first word; a single word scores count(w) / words. A document's score is the sum
of the natural logarithms over its words, with histories that start in it.

The relations are kept in packed form. A batch of documents becomes one row of
word hashes. It is exploded into n-grams, which are counted within the batch,
sorted by hash and cut at the borders of ``parts`` hash partitions: a row for
each batch, order and partition. A partition adds up its rows' counts (a gram
that is everywhere comes once from each batch, so no key is hot) and answers
each of them with the corpus counts of its grams. Joined on the batch, the
answers give each n-gram its counts, and they are summed for each document.

Words are runs of characters other than blank, tab and line controls, A-Z
lower-cased, known by 64-bit hashes; n-grams by 56-bit ones. N-grams whose hashes are equal
share their counts: of g different n-grams about one in 2 ** 56 / g has such a neighbour, 2 in 10,000 at 1.5e13.
A row for each batch, order and partition is at most a row for each n-gram. An empty table gives an empty result. Cases: a null text,
or one without words, has 0 words, score 0 and a null mean. Ids may be null or
repeated: a row is scored where it stands. A text longer than a batch is a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise_bucketed

_MIX = np.uint64(0x9E3779B97F4A7C15)
GRAM_BITS = 56


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes of their differences (sorted ones shrink most)."""
    v = np.asarray(values, "<u8")
    d = np.diff(v, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers as they stand, byte planes compressed: best where nearly all are small."""
    v = np.asarray(values, "<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_small(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(word_hash: np.ndarray, doc_of: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``order``: hashes of the n-grams and the positions at which they end."""
    out, code = [], word_hash.copy()
    n_words = len(word_hash)
    for n in range(1, order + 1):
        if n > 1:
            code = (code[:-1] ^ (code[:-1] >> np.uint64(29))) * _MIX + word_hash[n - 1 :]
        at = np.arange(n - 1, n_words)
        whole = doc_of[n - 1 :] == doc_of[: n_words - n + 1]
        x = code[whole]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(((x ^ (x >> np.uint64(31))) >> np.uint64(64 - GRAM_BITS), at[whole]))
        if len(code) < 2:
            out += [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * (order - n)
            break
    return out


def _tokens(docs: DataFrame, id_col: str, text_col: str, batch_tokens: int) -> DataFrame:
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"batch string, doc_ids array<{key}>, lens binary, vocab binary, codes binary, n long"

    def run(batches):
        ids, lens, found, size, made = [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def row():
            # distinct words of the batch, each hashed once
            flat = [w for doc in found for w in doc]
            place = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place))
            sort = np.argsort(hashes, kind="stable")
            rank = np.empty(len(sort), np.uint32)
            rank[sort] = np.arange(len(sort), dtype=np.uint32)
            codes = rank[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))]
            planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            return pd.DataFrame([{
                "batch": f"{part}-{made}", "doc_ids": ids, "lens": pack_small(np.array(lens, np.uint64)), "vocab": pack(hashes[sort]),
                "codes": zstandard.ZstdCompressor(level=1).compress(planes), "n": len(flat)}])

        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["t"], strict=True):
                w = words(t)
                if ids and (size + len(w) > batch_tokens or len(ids) >= 100_000):
                    yield row()
                    ids, lens, found, size, made = [], [], [], 0, made + 1
                ids.append(None if pd.isna(d) else d)
                lens.append(len(w))
                found.append(w)
                size += len(w)
        if ids:
            yield row()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, schema)


def _restored(lens: bytes, vocab: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the document of each word, and the lengths of the documents."""
    lens = unpack_small(lens).astype(np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(codes), np.uint8).reshape(4, -1)
    code = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return unpack(vocab)[code], np.repeat(np.arange(len(lens)), lens), lens


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2,
    batch_tokens: int = 1_000_000, part_tokens: int = 2_000_000, buckets: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, score, mean_score.

    The batches are kept in ``buckets`` (by default twice the shuffle partitions, 32 at least), where
    the answers are brought to them.
    """
    buckets = buckets or max(32, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = docs.schema[id_col].dataType.simpleString()
    tokens = materialise_bucketed(_tokens(docs, id_col, text_col, batch_tokens), "lm-tokens", "batch", buckets)
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_tokens))
    borders = np.array([(i << GRAM_BITS) // parts for i in range(parts + 1)], np.uint64)

    def slices(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                word_hash, doc_of, _ = _restored(r.lens, r.vocab, r.codes)
                for n, (h, _) in enumerate(grams(word_hash, doc_of, order), 1):
                    h = np.sort(h)
                    new = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0) if len(h) else np.zeros(0, np.int64)
                    times, h = np.diff(np.append(new, len(h))), h[new]
                    cut = np.searchsorted(h, borders)
                    rows = [(n, p, r.batch, pack(h[a:b]), pack_small(times[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                    if rows:
                        yield pd.DataFrame(rows, columns=["ord", "part", "batch", "grams", "times"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        every = [unpack(b) for b in pdf["grams"]]
        ends = np.cumsum([len(x) for x in every])
        flat = np.concatenate(every)
        del every
        sort = np.argsort(flat, kind="stable")
        flat = flat[sort]
        new = np.flatnonzero(np.diff(flat, prepend=flat[:1] + np.uint64(1)) != 0)
        times = np.concatenate([unpack_small(b) for b in pdf["times"]]).astype(np.int64)[sort]
        sums = np.repeat(np.add.reduceat(times, new), np.diff(np.append(new, len(flat))))
        corpus = np.empty(len(flat), np.int64)
        corpus[sort] = sums
        return pd.DataFrame({
            "batch": pdf["batch"], "ord": pdf["ord"], "part": pdf["part"], "corpus": [pack_small(x) for x in np.split(corpus, ends[:-1])],
        })

    counted = (
        tokens.select("batch", "lens", "vocab", "codes")
        .mapInPandas(slices, "ord int, part int, batch string, grams binary, times binary")
        .groupBy("ord", "part").applyInPandas(count, "batch string, ord int, part int, corpus binary")
    )

    def score(held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = held.iloc[0]
        word_hash, doc_of, lens = _restored(r["lens"], r["vocab"], r["codes"])
        counts = []
        for n, (h, at) in enumerate(grams(word_hash, doc_of, order), 1):
            own = answers[answers["ord"] == n].sort_values("part")
            corpus = np.concatenate([unpack_small(b) for b in own["corpus"]]).astype(np.float64) if len(own) else np.zeros(0)
            sort = np.argsort(h, kind="stable")
            step = np.diff(h[sort], prepend=h[sort][:1]) != 0 if len(h) else np.zeros(0, bool)
            c = np.zeros(len(word_hash))
            c[at[sort]] = corpus[np.cumsum(step)] if len(h) else 0
            counts.append(c)  # by the position where the n-gram ends; 0 where none can
        if not len(word_hash):
            logs = np.zeros(0)
        else:
            logs = np.log(counts[0] / total)
            for n in range(1, order):
                past = np.concatenate([[0.0], counts[n - 1][:-1]])
                can = counts[n] > 0  # the document has the whole history
                good = counts[n] >= min_count
                logs = np.where(good, np.log(np.where(good, counts[n], 1) / np.where(good, past, 1)), np.where(can, logs + np.log(alpha), logs))
        sums = np.bincount(doc_of, logs, len(lens)) if len(lens) else np.zeros(0)
        return pd.DataFrame({
            "doc_id": pd.Series(list(r["doc_ids"]), dtype=object), "n_words": lens, "score": np.round(sums, 6),
            "mean_score": pd.Series([round(s / n, 6) if n else None for s, n in zip(sums, lens, strict=True)], dtype=object),
        })

    return tokens.groupBy("batch").cogroup(counted.groupBy("batch")).applyInPandas(
        score, f"doc_id {key}, n_words long, score double, mean_score double"
    )
