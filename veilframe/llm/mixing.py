"""Operator 9: mixing sources to target weights by a min-cost flow.

A document may belong to several sources. Documents are aggregated by membership
pattern; a network routes each pattern's word capacity to the quotas of its
sources, in layers: the first use of a word is free, the second costs more than
the first, the third more than the second. The network has one node for each
pattern and source, however many documents there are, and is solved on the driver;
sources that no pattern joins are solved apart, each by one short search, so that what grows
beyond a moment is only a network of very many patterns that overlap. Where every document has one
source, each network is one arc and the flow settles how often a source is repeated. A pattern that is to give f words of its s gives
every document floor(f / s) times, and then seeded documents once more until the
remainder is met: in the order of a seeded hash of id and text as long as they fit, and then the
one document whose size is nearest to what is still missing.

The order within a pattern comes from sums over hash buckets and a running sum
inside the one bucket where the remainder is crossed, so no task sees a whole
source. Cases: a null text has size 0 and is never taken; null sources are a
source of their own, last in order; rows equal in id and text have one key and are shared by their number: so many of
them are taken as fit. An empty table gives an empty result. Columns other than the three named are ignored.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BUCKETS = 4096
#: Patterns up to which tables of a row or two for each are broadcast: some 20 MB. With more they are joined by shuffles.
BROADCAST = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab and the four line controls."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], times: int = 3) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``times`` its size, the excess reshared."""
    total = float(sum(sizes))
    order = sorted(range(len(sizes)), key=lambda i: (times * sizes[i] / weights[i], i))
    target, left, weight = [0.0] * len(sizes), total, float(sum(weights))
    for n, i in enumerate(order):
        if times * sizes[i] * weight >= left * weights[i]:
            for j in order[n:]:
                target[j] = left * weights[j] / weight
            return target
        target[i] = float(times * sizes[i])
        left -= target[i]
        weight -= weights[i]
    return target


def route(patterns: dict[tuple[int, ...], int], quotas: list[int], layers: int = 3) -> dict[tuple[tuple[int, ...], int], int]:
    """Min-cost flow from patterns (their sources: their words) to quotas by source.

    The k-th use of a pattern's words costs k squared a word. Returns the words that each pattern
    gives each source. Sources that no pattern joins, directly or by others, are networks of their own
    and solved apart, so a source that overlaps with none is one short search.
    """
    root = list(range(len(quotas)))

    def top(j: int) -> int:
        while root[j] != j:
            root[j] = j = root[root[j]]
        return j

    for key in patterns:
        for j in key[1:]:
            root[top(j)] = top(key[0])
    apart: dict[int, list[tuple[int, ...]]] = {}
    for key in sorted(filter(None, patterns)):
        apart.setdefault(top(key[0]), []).append(key)
    used: dict[tuple[tuple[int, ...], int], int] = {}
    for keys in apart.values():
        used |= _flow({k: patterns[k] for k in keys}, {j: quotas[j] for k in keys for j in k}, layers)
    return used


def _flow(patterns: dict[tuple[int, ...], int], quotas: dict[int, int], layers: int) -> dict[tuple[tuple[int, ...], int], int]:
    """``route`` of one network, by successive shortest paths with potentials."""
    keys, names = sorted(patterns), sorted(quotas)
    place = {j: n for n, j in enumerate(names)}
    p, s = len(keys), len(names)
    source, sink = p + s, p + s + 1
    graph: list[list[list]] = [[] for _ in range(p + s + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        forth, back = [b, room, cost, None], [a, 0, -cost, None]
        forth[3], back[3] = back, forth
        graph[a].append(forth)
        graph[b].append(back)
        return forth

    used = {}
    for i, key in enumerate(keys):
        for k in range(layers):
            arc(source, i, patterns[key], k * k)
        for j in key:
            used[key, j] = arc(i, p + place[j], layers * patterns[key], 0)
    for j in names:
        arc(p + place[j], sink, quotas[j], 0)
    height = [0] * len(graph)
    while True:
        best, back = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for e in graph[a]:
                if e[1] > 0 and (n := d + e[2] + height[a] - height[e[0]]) < best.get(e[0], 1 << 60):
                    best[e[0]], back[e[0]] = n, e
                    heapq.heappush(heap, (n, e[0]))
        if sink not in best:
            break
        top = max(best.values())
        for a in range(len(graph)):
            height[a] += best.get(a, top)
        flow, at = 1 << 62, sink
        while at != source:
            flow, at = min(flow, back[at][1]), back[at][3][0]
        at = sink
        while at != source:
            e = back[at]
            e[1] -= flow
            e[3][1] += flow
            at = e[3][0]
    return {k: e[3][1] for k, e in used.items() if e[3][1]}


def _rank_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded order that SQL engines share: the md5 of id, seed and the text's md5."""
    return F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(str(seed)), F.md5(F.coalesce(text, F.lit("")))).cast("binary"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of a row or two for each pattern, broadcast while its number of patterns is known to be small."""
    return F.broadcast(table) if rows <= BROADCAST else table


def selection_rules(rows: DataFrame, wants: DataFrame, times: int, patterns: int) -> DataFrame:
    """Rules (pattern, base, cut_key, part_key, part_rows, pick_key, pick_rows), one for each pattern, that bring the words taken of
    ``rows`` (pattern, size, rank_key, bucket) near ``wants`` (pattern, pattern_size, want).

    A document is taken ``base`` times, and once more if its key is at most ``cut_key``, if it is one of the first
    ``part_rows`` of the rows that have ``part_key``, or the first ``pick_rows`` of ``pick_key``.
    """
    wants = _small(
        wants.withColumn("base", F.expr(f"if(pattern_size = 0, 0, least(want div pattern_size, {times}))"))
        .select("pattern", "base", F.expr(f"if(base >= {times}, 0, want - base * pattern_size)").alias("rest")), patterns)
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("words").over(run)).join(wants, "pattern")  # at most BUCKETS rows a pattern
    # the bucket of each pattern in which the running sum passes the remainder
    cross = sums.where("upto > rest AND upto - words <= rest").select("pattern", "bucket", (F.col("upto") - F.col("words")).alias("before"), "rest")
    cross = materialise(cross, "mix-cross")
    inner = Window.partitionBy("pattern").orderBy("rank_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = (
        rows.join(_small(cross, patterns), ["pattern", "bucket"]).groupBy("pattern", "before", "rest", "rank_key")
        .agg(F.sum("size").alias("size"), F.max("size").alias("unit")).withColumn("upto", F.col("before") + F.sum("size").over(inner))
    )
    fine = materialise(fine, "mix-fine")
    last = fine.where("upto <= rest").groupBy("pattern").agg(F.max("rank_key").alias("last"))
    # the rows of the key where the remainder is passed: as many as fit
    part = fine.where("upto > rest AND upto - size <= rest").select(
        "pattern", F.col("rank_key").alias("part_key"), F.expr("(rest - (upto - size)) div unit").alias("part_rows"),
        F.expr("rest - (upto - size) - unit * ((rest - (upto - size)) div unit)").alias("gap"))
    # the prefix of the bucket itself is above all keys before it and below all keys in it
    cuts = cross.join(_small(last, patterns), "pattern", "left").join(_small(part, patterns), "pattern")
    cuts = materialise(cuts.select("pattern", F.coalesce("last", "bucket").alias("cut_key"), "part_key", "part_rows", "gap"), "mix-cuts")
    # what the order leaves short is met by the one document whose size is nearest to it
    picks = (
        rows.join(_small(cuts, patterns), "pattern").where("rank_key > cut_key AND size > 0 AND abs(gap - size) < gap")
        .groupBy("pattern").agg(F.min(F.struct(F.expr("abs(gap - size)").alias("off"), "rank_key"))["rank_key"].alias("pick_key"))
    )
    rules = wants.select("pattern", "base").join(_small(cuts, patterns), "pattern", "left").join(_small(picks, patterns), "pattern", "left")
    same = F.coalesce(F.col("pick_key") == F.col("part_key"), F.lit(False))
    return materialise(rules.select(
        "pattern", "base", "cut_key", "part_key", (F.col("part_rows") + same.cast("long")).alias("part_rows"),
        F.when(~same, F.col("pick_key")).alias("pick_key")), "mix-rules")


def _special(rows: DataFrame, rules: DataFrame, patterns: int) -> DataFrame | None:
    """(pattern, rank_key) of the keys that are taken in part, where more than one row has them; None if no key is."""
    keys = rules.select("pattern", F.explode(F.array("part_key", "pick_key")).alias("rank_key")).where("rank_key IS NOT NULL")
    many = rows.join(_small(keys, patterns), ["pattern", "rank_key"]).groupBy("pattern", "rank_key").count().where("count > 1")
    many = materialise(many.select(F.col("pattern").alias("many_pattern"), F.col("rank_key").alias("many_key")), "mix-many")
    return None if many.isEmpty() else many


def _numbered(rows: DataFrame, special: DataFrame | None, patterns: int) -> DataFrame:
    """``rows`` with ``own_nth``: the number, from 0, among the rows of its key where that key is special, else 0.

    Rows are numbered within their partition, and the counts of the partitions are summed up, so that no key is gathered in one task.
    """
    if special is None:
        return rows.withColumn("own_nth", F.lit(0).cast("long"))
    met = (F.col("own_mix.pattern") == F.col("many_pattern")) & (F.col("own_mix.rank_key") == F.col("many_key"))
    few = materialise(rows.join(_small(special, patterns), met, "left_semi"), "mix-repeats").withColumn("own_part", F.spark_partition_id())
    key = ["own_mix.pattern", "own_mix.rank_key"]
    counts = few.groupBy(F.col(key[0]).alias("p"), F.col(key[1]).alias("k"), F.col("own_part").alias("part")).count()
    ahead = F.sum("count").over(Window.partitionBy("p", "k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("p", "k", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy(*key, "own_part").orderBy(F.lit(0)))
    numbered = few.withColumn("own_inside", inside).join(
        counts, (F.col(key[0]) == F.col("p")) & (F.col(key[1]) == F.col("k")) & (F.col("own_part") == F.col("part")))
    numbered = numbered.select(*rows.columns, (F.col("ahead") + F.col("own_inside") - 1).cast("long").alias("own_nth"))
    rest = rows.join(_small(special, patterns), met, "left_anti").withColumn("own_nth", F.lit(0).cast("long"))
    return rest.unionByName(numbered)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """The membership pattern of a row, as JSON, and its size."""
    several = docs.schema[source_col].dataType.typeName() == "array"
    member = F.array_sort(F.array_distinct(F.col(source_col))) if several else F.array(F.col(source_col).cast("string"))
    return F.to_json(F.coalesce(member, F.array(F.lit(None).cast("string")))), word_count(F.col(text_col).cast("string"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), times: int = 3, seed: int = 11,
) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """The table of (doc_id, pattern, size, rank_key, bucket), the rule of each pattern, the keys taken in part that several
    rows have, and the number of patterns. The driver holds a row for each pattern."""
    pattern, size = _sized(docs, id_col, text_col, source_col)
    key = _rank_key(F.col(id_col), F.col(text_col).cast("string"), seed)
    sized = docs.select(F.col(id_col).alias("doc_id"), pattern.alias("pattern"), size.alias("size"), key.alias("rank_key"))
    sized = materialise(sized.withColumn("bucket", F.substring("rank_key", 1, 3)), "mix-sizes")
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    spark = docs.sparkSession
    parsed = {r["pattern"]: json.loads(r["pattern"]) for r in totals}
    names = sorted({x for p in parsed.values() for x in p if x is not None}) + [None] * any(None in p for p in parsed.values())
    place = {n: i for i, n in enumerate(names)}
    size_of = [0] * len(names)
    for r in totals:
        for x in parsed[r["pattern"]]:
            size_of[place[x]] += r["words"]
    targets = water_fill(size_of, [weights[i % len(weights)] for i in range(len(names))], times)
    flow = route({(*sorted(place[x] for x in parsed[r["pattern"]]),): r["words"] for r in totals}, [int(t + 0.5) for t in targets], times)
    wants: dict[str, int] = {}
    for r in totals:
        key = (*sorted(place[x] for x in parsed[r["pattern"]]),)
        wants[r["pattern"]] = sum(flow.get((key, j), 0) for j in key)
    rows = [
        (r["pattern"], int(r["words"]), wants[r["pattern"]], sum(size_of[place[x]] for x in parsed[r["pattern"]]),
         round(sum(targets[place[x]] for x in parsed[r["pattern"]]), 6))
        for r in totals
    ]
    plan = spark.createDataFrame(rows, "pattern string, pattern_size long, want long, source_size long, target double")
    rules = selection_rules(sized, plan.select("pattern", "pattern_size", "want"), times, len(rows))
    special = _special(sized, rules, len(rows))
    rules = rules.join(plan, "pattern").select(
        F.struct("pattern", "source_size", "target", "base", "cut_key", "part_key", "part_rows", "pick_key").alias("rule"))
    return sized, rules, special, len(rows)


def _decided(rows: DataFrame, rules: DataFrame, special: DataFrame | None, patterns: int) -> DataFrame:
    """``rows`` with the struct column ``own_mix`` (pattern, size, rank_key), and ``mixed`` from the rules.

    No row but those of a special key is moved: the decision follows from its own key and the rules of its pattern.
    """
    both = _numbered(rows, special, patterns).join(_small(rules, patterns), F.col("own_mix.pattern") == F.col("rule.pattern"), "left")
    key, no = F.col("own_mix.rank_key"), F.lit(False)
    once_more = (
        F.coalesce(key <= F.col("rule.cut_key"), no)
        | F.coalesce((key == F.col("rule.part_key")) & (F.col("own_nth") < F.col("rule.part_rows")), no)
        | F.coalesce((key == F.col("rule.pick_key")) & (F.col("own_nth") == 0), no)
    )
    return both.select("*", F.struct(
        F.col("own_mix.pattern").alias("sources"), "own_mix.size", F.col("rule.source_size"), F.col("rule.target"),
        (F.col("rule.base") + once_more.cast("int")).cast("int").alias("copies"),
    ).alias("mixed"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **options) -> DataFrame:
    """``docs`` with the struct column ``mixed`` of sources, size, source_size, target and copies."""
    _, *plan = plan_mix(docs, id_col, text_col, source_col, seed=seed, **options)
    pattern, size = _sized(docs, id_col, text_col, source_col)
    key = _rank_key(F.col(id_col), F.col(text_col).cast("string"), seed)
    own = F.struct(pattern.alias("pattern"), size.alias("size"), key.alias("rank_key"))
    return _decided(docs.withColumn("own_mix", own), *plan).select(*docs.columns, "mixed")


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, sources, size, source_size, target, taken, copies.

    ``source_col`` is a string, or an array of strings where documents belong to several sources; then
    source_size and target are sums over them and the flow settles which quota a document serves.
    Sources in code-point order, null last, take the ``weights`` in turn.
    """
    sized, *plan = plan_mix(docs, id_col, **options)
    return _decided(sized.select("doc_id", F.struct("pattern", "size", "rank_key").alias("own_mix")), *plan).select(
        "doc_id", "mixed.sources", "mixed.size", "mixed.source_size", "mixed.target",
        (F.col("mixed.copies") * F.col("mixed.size")).cast("long").alias("taken"), "mixed.copies",
    )
