"""Operator 10: language by string kernels.

Two texts are alike as their sets of character n-grams are: the kernel is the
number of n-grams of one to ``orders`` characters that both have, divided by the
root of the product of the numbers each has (a blended-spectrum presence kernel
of norm one). Letters are lower-cased and everything else counts as one blank.
N-grams are hashed to ``2**bits`` places. ``landmarks`` texts for each language give the Nystroem features, and one ridge regression for each language
against the rest is solved in closed form. Scoring is two matrix products for
each batch: presence times landmarks, kernels times weights.

Every language that a row is labelled with is learned. Fitting takes at most ``per_lang`` labelled rows of each, the first by a
seeded hash of id and text (rows equal in both teach once), as presence bits of whole texts (2**bits / 8 bytes each).
Where languages are many each has fewer, so that rows are ``max_rows`` and landmarks ``max_marks`` in all, but one of each
language at least. These are the documented bounds of what reaches the driver, with a count for each language.

Cases: a null text, or one without letters, is ``und`` with score 0; ties go to
the smaller label; with no labelled row all else is ``und`` too. Texts are read
whole. Repeated rows give equal results.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
#: Characters of a text that are worked on at once.
SLICE = 1 << 16


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def presence(text: str | None, bits: int, orders: int) -> np.ndarray | None:
    """Places (sorted, distinct) of the n-grams of a text; None if it has no letters."""
    if not text:
        return None
    seen, held, after_letter, any_letter = np.zeros(1 << bits, bool), np.array([32], np.uint64), False, False

    def mark(cps: np.ndarray) -> None:
        code = np.zeros(len(cps), np.uint64)
        for n in range(1, min(orders, len(cps)) + 1):
            code = code[: len(cps) - n + 1] * np.uint64(0x110000) + cps[n - 1 :] + np.uint64(1)
            seen[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)] = True

    for at in range(0, len(text), SLICE):
        cps = _fold()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")]
        letters = cps != 32
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        keep[0] |= after_letter  # the blank after a letter that ended the slice before
        after_letter, any_letter = bool(letters[-1]), any_letter or bool(letters.any())
        held = np.concatenate((held, cps[keep].astype(np.uint64)))
        mark(held)
        held = held[max(0, len(held) - orders + 1) :]
    if not any_letter:
        return None
    mark(np.concatenate((held, np.array([32], np.uint64))))
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class KernelModel:
    langs: list[str]
    landmarks: np.ndarray  # packed presence bits, a row each
    weights: np.ndarray  # landmarks x languages
    bits: int
    orders: int


def _kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Presence rows against landmark rows. The counts are whole numbers below 2**24, so exact."""
    both = (x @ marks.T).astype(np.float64)
    return both / np.sqrt(np.maximum(x.sum(1, dtype=np.float64), 1))[:, None] / np.sqrt(np.maximum(marks.sum(1, dtype=np.float64), 1))


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 14,
    orders: int = 3, per_lang: int = 400, landmarks: int = 32, max_rows: int = 25_600, max_marks: int = 2_048, ridge: float = 0.1, seed: int = 7,
) -> KernelModel:
    """Learn from rows (id, text, lang); rows with a null text or lang teach nothing."""
    rows = labelled.select(
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"),
        F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"),
    ).where("t IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("texts"))
    counts = counts.collect()
    if not counts:
        return KernelModel([], np.zeros((0, (1 << bits) // 8), np.uint8), np.zeros((0, 0)), bits, orders)
    u = (F.col("h").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")
    per_lang, landmarks = min(per_lang, max(1, max_rows // len(counts))), min(landmarks, max(1, max_marks // len(counts)))
    bounds = labelled.sparkSession.createDataFrame([(r["lang"], 3.0 * max(per_lang, 8) / r["texts"]) for r in counts], "lang string, bound double")

    def bitrows(batches):
        for pdf in batches:
            out = []
            for h, t, lang in zip(pdf["h"], pdf["t"], pdf["lang"], strict=True):
                if (p := presence(t, bits, orders)) is not None:
                    x = np.zeros(1 << bits, bool)
                    x[p] = True
                    out.append((lang, h & ((1 << 53) - 1), h, np.packbits(x).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "u", "h", "bits"])

    # about 3 * per_lang texts of a language pass the hash bound, whatever the size of the table; repeated rows pass as one
    got = rows.join(F.broadcast(bounds), "lang").where(u <= F.col("bound")).dropDuplicates(["lang", "h"]).select("h", "t", "lang").mapInPandas(bitrows, "lang string, u long, h long, bits binary").collect()
    picked: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["u"], r["h"], r["bits"])):
        own = picked.setdefault(r["lang"], [])
        if len(own) < per_lang:
            own.append(bytes(r["bits"]))
    langs = sorted(picked)
    if not langs:
        return KernelModel([], np.zeros((0, (1 << bits) // 8), np.uint8), np.zeros((0, 0)), bits, orders)
    unpack = lambda b: np.unpackbits(np.frombuffer(b, np.uint8)).astype(np.float32)
    marks = np.stack([unpack(b) for g in langs for b in picked[g][:landmarks]])
    x = [b for g in langs for b in picked[g]]
    y = np.concatenate([np.full(len(picked[g]), k) for k, g in enumerate(langs)])
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    share = 1.0 / np.bincount(y, minlength=len(langs))[y]  # each language weighs the same
    w = (share * len(y) / len(langs))[:, None]
    left, right = ridge * np.eye(len(marks)), np.zeros((len(marks), len(langs)))
    for at in range(0, len(x), 2048):
        part = slice(at, at + 2048)
        z = _kernel(np.stack([unpack(b) for b in x[part]]), marks) @ root
        left += z.T @ (w[part] * z)
        right += z.T @ (w[part] * (y[part][:, None] == np.arange(len(langs))))
    beta = np.linalg.solve(left, right)
    return KernelModel(langs, np.packbits(marks.astype(bool), axis=1), root @ beta, bits, orders)


def predict(docs: DataFrame, model: KernelModel, text_col: str = "text", batch: int = 128) -> DataFrame:
    """``docs`` with the struct column ``language`` of lang_pred, score and grams, the n-gram places that the text has."""

    def score(texts: pd.Series) -> pd.DataFrame:
        marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        pred, conf, grams = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        for at in range(0, len(texts) if model.langs else 0, batch):
            part = texts.iloc[at : at + batch]
            x = np.zeros((len(part), 1 << model.bits), np.float32)
            has = []
            for i, t in enumerate(part):
                if (p := presence(t, model.bits, model.orders)) is not None:
                    x[i, p] = 1
                    grams[at + i] = len(p)
                    has.append(i)
            if has:
                f = np.round(_kernel(x[has], marks) @ model.weights, 6)
                best = f.argmax(1)
                for i, b, v in zip(has, best, f[np.arange(len(has)), best], strict=True):
                    pred[at + i], conf[at + i] = model.langs[b], min(1.0, max(0.0, float(v)))
        return pd.DataFrame({"lang_pred": pred, "score": conf, "grams": grams})

    score.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    # the mark keeps a filter on the prediction above it: pushed below, it would have every text scored twice, by two workers
    once = F.pandas_udf(score, "lang_pred string, score double, grams int").asNondeterministic()
    scored: Column = once(F.col(text_col).cast("string"))
    return docs.withColumn("language", scored)


#: Words of the cuts of texts that show what short texts score.
CUTS = (1, 2, 3, 5, 8, 16, 32, 100)


def least_scores(
    labelled: DataFrame, model: KernelModel, text_col: str = "text", lang_col: str = "lang", per_lang: int = 400,
    quantile: float = 0.01, part: float = 0.5, least: float = 0.02, seed: int = 7,
) -> list[float]:
    """Scores that a text of a learned language hardly falls below, by the binary digits of its number of n-gram places.

    They are ``part`` of the low ``quantile`` of the scores of ``labelled`` rows that are predicted right, about
    ``per_lang`` of each language and their first words, the lowest of any language; none is below ``least`` or below
    that of shorter texts. The rows should be held out, as those that teach score too well.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    u = F.xxhash64(F.lit(seed), "t").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = rows.join(F.broadcast(counts), "lang").where(u < per_lang / F.col("rows")).distinct()
    words = F.split(F.left(F.trim("t"), F.lit(64 * CUTS[-1])), "\\s+")  # only first words are wanted, of texts of any length
    cuts = F.array(F.col("t"), *[F.array_join(F.slice(words, 1, k), " ") for k in CUTS])
    scored = predict(drawn.select("lang", F.explode(F.array_distinct(cuts)).alias("t")), model, "t")
    right = scored.where("language.lang_pred = lang").select("lang", F.length(F.bin(F.col("language.grams").cast("long"))).alias("size"), "language.score")
    low = right.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("rows"), F.percentile("score", quantile).alias("low")).where("rows >= 20")
    got = {r["size"]: r["low"] for r in low.groupBy("size").agg(F.min("low").alias("low")).collect()}
    out = [least]
    for size in range(1, 32):
        out.append(max(out[-1], part * got.get(size, 0.0)))
    return out


def fits(floors: list[float], language: str = "language") -> Column:
    """Whether a prediction is a learned language's and its score is no less than texts of that size have."""
    size = F.length(F.bin(F.col(f"{language}.grams").cast("long")))
    floor = F.element_at(F.array(*[F.lit(x) for x in floors]), size + 1)
    return (F.col(f"{language}.lang_pred") != UND) & (F.col(f"{language}.score") >= floor)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the documents that never teach."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(narrow.where(~held_out()), **options)
    return predict(narrow.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score"
    )
