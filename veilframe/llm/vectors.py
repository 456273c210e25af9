"""Operators 1 and 8: near-duplicate and nearest vectors.

A vector takes part if it is not null, not zero and all its components are finite
numbers; vectors of other lengths never meet. Equal vectors are collapsed first. A row
is a vector of its own for operator 1, also where it repeats another's id; operator 8
takes rows equal in id and vector as one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hash_order, materialise
from .local import star_labels


def _usable(vec: str = "vec"):
    return F.coalesce(
        F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False)
    )


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- operator 1: inverted multi-index


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of k-means over the rows of x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for j in range(len(centres)):
            if (own := near == j).any():
                centres[j] = x[own].mean(0)
    return np.unique(centres, axis=0)


def half_bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and for every centre the least squared distance
    from the row to that centre's cell: zero for its own, else to the plane between."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    own = d.argmin(1)
    between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[own]
    gap = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * between, 1e-300)
    gap[np.arange(len(x)), own] = 0
    return own, np.maximum(gap, 0) ** 2


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float):
    """Cells (i, j) of the product grid by rising first[i] + second[j], up to ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            return
        yield int(a[i]), int(b[j])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (first[a[n[0]]] + second[b[n[1]]], *n))


def near_vectors(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93,
    sample: int = 4096, block: int = 512, seed: int = 17, per_cell: int = 4096,
) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine is at least ``threshold``.
    Each half of the unit vectors has a codebook, fitted on at most ``sample`` rows, and the product of
    both is the grid of cells. A vector visits cells in multi-sequence order of the least distance that
    any vector of the cell can have from it, and stops where that exceeds the distance at the threshold:
    the target recall is one, whatever the sample was. Pairs of the cells visited are verified by exact
    cosines, ``block`` residents against ``block`` visitors at a time, so that a cell with a third of
    all rows is many tasks; what leaves a task is a count for each vector and a spanning star.
    The centres of a half are about the root of the number of cells of ``per_cell`` vectors, the sample 16 rows for each.
    Lengths of ``per_cell`` vectors at most have one cell each and are verified together, however many lengths there are.

    Vectors that take no part, and those with a null label or id, have no links and are kept. A repeated row is linked with the
    row it repeats; two vectors under one id are two rows, each with links and a component of its own.
    """
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
        (F.col(label_col) if label_col else F.lit(0)).cast("string").alias("label"),
    ).withColumn("fit", _usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = materialise(rows, "vec-rows")
    nodes = rows.where("fit").groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # numbered when it is written; an id is no name for a vector, as several may have it
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vec-nodes")
    large = {r[0]: r[1] for r in nodes.groupBy(F.size("vec").alias("dim")).count().where(F.col("count") > per_cell).collect()}
    reach = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors at the threshold
    group = nodes.select(F.concat_ws(":", F.size("vec"), "label").alias("label"), "node", "copies", "vec")
    small = group.where(~F.size("vec").isin(*large)) if large else group
    counts = None if large and small.isEmpty() else _verified(small.withColumn("cells", F.array(F.lit(0))), threshold, block)
    for dim, n in sorted(large.items()):
        own = group.where(F.size("vec") == dim)
        k = max(4, round((n / per_cell) ** 0.5))
        drawn = own.select("vec").orderBy(hash_order(seed, F.col("vec"))).limit(max(sample, 16 * k)).collect()
        unit = _unit(np.array([r[0] for r in drawn], float))
        half = max(1, dim // 2)
        books = codebook(unit[:, :half].copy(), k, seed), codebook(unit[:, half:].copy(), k, seed + 1) if dim > 1 else np.zeros((1, 0))
        found = _verified(_posted(own, books, half, reach), threshold, block)
        counts = found if counts is None else counts.unionByName(found)
    counts = materialise(counts, "vec-found")
    links = connected_components(counts.where("tip IS NOT NULL").select(F.col("node").alias("u"), F.col("tip").alias("v")), "vec-cc")
    sums = counts.groupBy("node").agg(F.sum("n").alias("n"))
    met = nodes.join(sums, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = met.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = met.join(lows, "component").select(
        F.col("label").alias("l2"), F.col("vec").alias("v2"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    met = rows.where("fit").join(classes, (F.col("label") == F.col("l2")) & (F.col("vec") == F.col("v2")), "left")
    out = met.select("vec_id", "n_links", "component_id").unionByName(
        rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _posted(nodes: DataFrame, books, half: int, reach: float) -> DataFrame:
    """``nodes`` with the cells that each visits, its own first."""
    wide = len(books[1])

    def visit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(_matrix(pdf["vec"]))
            (a, da), (b, db) = half_bounds(x[:, :half], books[0]), half_bounds(x[:, half:], books[1])
            cells = []
            for i in range(len(pdf)):
                own = int(a[i]) * wide + int(b[i])
                cells.append([own] + [c for p, q in multi_sequence(da[i], db[i], reach) if (c := p * wide + q) > own])
            yield pd.DataFrame({"label": pdf["label"], "node": pdf["node"], "copies": pdf["copies"], "vec": pdf["vec"], "cells": cells})

    schema = "label string, node long, copies long, vec array<double>, cells array<int>"
    return materialise(nodes.select("label", "node", "copies", "vec").mapInPandas(visit, schema), "vec-posted")


def _verified(posted: DataFrame, threshold: float, block: int) -> DataFrame:
    """Partial results (node, n, tip): links counted with copies, and a node it is linked with."""
    home = posted.select("label", F.element_at("cells", 1).alias("cell"), "node", "copies", "vec")
    visits = posted.select("label", F.explode("cells").alias("cell"), "node", "copies", "vec", F.element_at("cells", 1).alias("own"))
    sizes = home.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rb"))
    guests = posted.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pb"))
    grid = materialise(sizes.join(guests, ["label", "cell"]), "vec-grid")
    slot = lambda n: F.expr(f"cast(pmod(xxhash64(node), {n}) as int)")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = home.join(grid, ["label", "cell"]).select(
        "label", "cell", slot("rb").alias("r"), spread("pb").alias("p"), F.lit(True).alias("home"), F.lit(True).alias("native"), "node", "copies", "vec")
    visitors = visits.join(grid, ["label", "cell"]).select(
        "label", "cell", spread("rb").alias("r"), slot("pb").alias("p"), F.lit(False).alias("home"), (F.col("own") == F.col("cell")).alias("native"), "node", "copies", "vec")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        here, there = pdf[pdf["home"]], pdf[~pdf["home"]]
        if not len(here) or not len(there):
            return pd.DataFrame({"node": [], "n": [], "tip": []})
        near = _unit(_matrix(there["vec"])) @ _unit(_matrix(here["vec"])).T >= threshold
        v, r = there["node"].to_numpy(), here["node"].to_numpy()
        # within the cell every pair is met from both sides; it counts from the smaller id
        near &= ~there["native"].to_numpy()[:, None] | (v[:, None] < r[None])
        i, j = np.nonzero(near)
        nodes = np.unique(np.concatenate([v[i], r[j]]))
        if not len(nodes):
            return pd.DataFrame({"node": [], "n": [], "tip": []})
        a, b = np.searchsorted(nodes, v[i]), np.searchsorted(nodes, r[j])
        n = np.bincount(a, here["copies"].to_numpy()[j], len(nodes)) + np.bincount(b, there["copies"].to_numpy()[i], len(nodes))
        tip = nodes[star_labels(len(nodes), a, b)]
        return pd.DataFrame({"node": nodes, "n": n.astype("int64"), "tip": tip})

    both = residents.unionByName(visitors)
    return both.groupBy("label", "cell", "r", "p").applyInPandas(verify, "node long, n long, tip long")


# ---------------------------------------------------------------- operator 8: permutation index


def nearest(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, top: int = 5, pivots: int = 256,
    prefix: int = 64, share: float = 0.3, block: int = 8192, query_block: int = 2048, seed: int = 23,
) -> DataFrame:
    """The ``top`` nearest by cosine of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``. ``pivots`` sampled vectors are the reference
    points; a vector is represented by its ``prefix`` nearest pivots in order. Within each block of
    rows, postings by pivot hold the rows that have the pivot in their prefix and its rank there. A query
    (laid out for it from the orders that are worked out once and kept) walks the postings of its own prefix and adds up the footrule distance (a pivot missing on one side
    counts as rank ``prefix``); only the ``share`` of the block with the least distance, ``top`` + 1 entries at least, is reranked, by
    exact cosines. So work and candidates are the same share at every size. Blocks of rows meet blocks of
    queries by key; a block's answers are ``top`` rows a query.

    Equal vectors of a block are one entry with its smallest ids: no more than ``top`` + 1 of them can be
    in an answer. Vectors that take no part, and rows without an id, are neither queries nor candidates. Rows equal in id and vector
    are one; of several vectors under one id each asks for itself, and the others are candidates for it.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(_usable() & F.col("vec_id").isNotNull())
    again = materialise(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("vec_id"), "ann-again")
    if not again.isEmpty():  # only these rows are moved
        rows = rows.join(again, "vec_id", "left_anti").unionByName(rows.join(again, "vec_id", "left_semi").distinct())
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    out = "query_id long, rank int, vec_id long, score double"
    spark = table.sparkSession
    parts = None
    for (dim, n, queries) in sorted(
        tuple(r) for r in rows.groupBy(F.size("vec").alias("dim")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()
    ):
        if not queries:
            continue
        own = rows.where(F.size("vec") == dim)
        marks = _unit(_pivots(own, int(n), pivots, seed))
        found = _searched(own, marks, int(n), int(queries), every, top, min(prefix, len(marks)), share, block, query_block)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], out)
    best = parts.groupBy("asker", "query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
    return best.select("query_id", F.posexplode(F.slice("all", 1, top)).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score")
    )


def _pivots(rows: DataFrame, n: int, pivots: int, seed: int) -> np.ndarray:
    """The ``pivots`` distinct vectors first in a seeded order, or all if they are fewer.

    They are sought among a hashed fraction of the rows, so that not every vector is moved; copies
    share a hash, so the fraction grows until it holds enough different ones.
    """
    drawn, share = rows.select("vec", (F.xxhash64(F.lit(seed), "vec").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")), 8 * pivots / n
    while True:
        got = drawn.where(F.col("u") < share).distinct().orderBy("u", "vec").limit(pivots).collect()
        if len(got) == pivots or share >= 1:
            return np.array([r["vec"] for r in got], float)
        share *= 16


def orders(x: np.ndarray, marks: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` pivots nearest to each row, nearest first."""
    return np.argsort(-(x @ marks.T), axis=1, kind="stable")[:, :prefix]


def footrule(queries: np.ndarray, rows: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distances between prefixes of permutations, by walking postings of the pivots.

    A pivot's posting says for every row how far before the prefix's end it stands there, 0 if it is
    not in it. Two prefixes that share nothing are farthest apart, and each pivot they share brings
    them nearer by twice the lesser of its two weights.
    """
    prefix = rows.shape[1]
    weight = np.arange(prefix, 0, -1, dtype=np.uint8 if prefix < 256 else np.uint32)
    posting = np.zeros((pivots, len(rows)), weight.dtype)
    posting[rows, np.arange(len(rows))[:, None]] = weight
    shared = [np.minimum(posting[perm], weight[:, None]).sum(axis=0, dtype=np.int32) for perm in queries]
    return prefix * (prefix + 1) - 2 * np.array(shared, np.int32).reshape(len(queries), len(rows))


def _searched(rows, marks, n, queries, every, top, prefix, share, block, query_block) -> DataFrame:
    nb, nq = -(-n // block), -(-queries // query_block)
    slot = lambda m, salt: F.expr(f"cast(pmod(xxhash64({salt}, vec_id), {m}) as int)")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def ordered(batches):
        for pdf in batches:
            if len(pdf):
                perms = orders(_unit(_matrix(pdf["vec"])), marks, prefix).astype("<u2")
                yield pdf.assign(perm=[p.tobytes() for p in perms])

    rows = materialise(rows.mapInPandas(ordered, "vec_id long, vec array<double>, row long, perm binary"), "ann-orders")
    data = rows.select(slot(nb, 1).alias("b"), spread(nq).alias("q"), F.lit(False).alias("asks"), "vec_id", "row", "vec", "perm")
    asks = rows.where(F.col("vec_id") % every == 0).select(
        spread(nb).alias("b"), slot(nq, 2).alias("q"), F.lit(True).alias("asks"), "vec_id", "row", "vec", "perm")
    whole = lambda perms: np.frombuffer(b"".join(perms), "<u2").reshape(len(perms), prefix).astype(np.int64)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, held = pdf[pdf["asks"]].sort_values(["vec_id", "row"]), pdf[~pdf["asks"]].sort_values(["vec_id", "row"])
        none = pd.DataFrame({"asker": [], "query_id": [], "vec_id": [], "score": []})
        if not len(ask) or not len(held):
            return none
        raw = _matrix(held["vec"])
        ids, row_of = held["vec_id"].to_numpy(), held["row"].to_numpy()
        _, first, back = np.unique(raw, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")  # entries by their smallest id
        entry = np.empty(len(order), np.int64)
        entry[order] = np.arange(len(order))
        back = entry[back.ravel()]
        grouped = np.argsort(back, kind="stable")
        bounds = np.searchsorted(back[grouped], np.arange(len(order) + 1))
        x, raw_q = raw[first[order]], _matrix(ask["vec"])
        ux, uq = _unit(x), _unit(raw_q)
        perms, asked = whole(held["perm"].to_numpy()[first[order]]), whole(ask["perm"].to_numpy())
        most = max(top + 1, int(np.ceil(share * len(x))))  # the query's own entry and ``top`` others at least
        norm, norm_q = np.sqrt((x * x).sum(1)), np.sqrt((raw_q * raw_q).sum(1))
        out = []
        for at in range(0, len(ask), 64):
            dist = footrule(asked[at : at + 64], perms, len(marks))  # the postings are laid out once for 64 queries
            if most < len(x):
                limit = np.partition(dist, most - 1, axis=1)[:, most - 1 : most]  # ties at the limit are in
            else:
                limit = np.full((len(dist), 1), np.iinfo(np.int32).max)
            for i in range(len(dist)):
                me, my_id = int(ask["row"].iloc[at + i]), int(ask["vec_id"].iloc[at + i])
                held_in = np.flatnonzero(dist[i] <= limit[i])
                rough = ux[held_in] @ uq[at + i]
                k = min(len(rough), top + 1)  # the query's own entry may be one of them
                cut = np.partition(rough, len(rough) - k)[len(rough) - k]
                near = held_in[rough >= cut - 1e-12]
                score = (x[near] * raw_q[at + i]).sum(1) / (norm[near] * norm_q[at + i])
                got = []
                for e, s in sorted(zip(near.tolist(), score.tolist(), strict=True), key=lambda z: (-z[1], z[0])):
                    if len(got) >= top and s < got[top - 1][0]:
                        break
                    own = grouped[bounds[e] : bounds[e + 1]][: top + 1]
                    got += [(s, int(ids[v])) for v in own if row_of[v] != me]
                    got.sort(key=lambda z: (-z[0], z[1]))
                out += [(me, my_id, v, s) for s, v in got[:top]]
        return pd.DataFrame(out, columns=["asker", "query_id", "vec_id", "score"]) if out else none

    both = data.unionByName(asks)
    return both.groupBy("b", "q").applyInPandas(search, "asker long, query_id long, vec_id long, score double")
