"""Operators on tables of few vectors, and of many languages or sources."""

import random

import numpy as np
from veilframe.llm import langid, vectors


def test_nearest_answers_in_full_on_few_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * size + i, [*map(float, rng.normal(size=size))]) for size in range(2, 17) for i in range(size)]
    got = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    answers = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        answers.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(a) for q, a in answers.items()} == {100 * size: min(5, size - 1) for size in range(2, 17)}
    assert all(len(set(a)) == len(a) and q not in a for q, a in answers.items())


def test_every_language_is_learned(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(4)) for _ in range(5)] for k in range(80)}
    rows = [(12 * k + i, " ".join(rng.choice(own[g]) for _ in range(30)), g) for k, g in enumerate(own) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, bits=12).collect()}
    assert sum(got[d] == g for d, _, g in rows) >= 0.99 * len(rows)
    few = {r.doc_id: r.lang_pred for r in langid.identify(df, bits=12, max_rows=160, max_marks=40).collect()}
    assert len({few[d] for d, *_ in rows}) == 80
