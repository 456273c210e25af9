"""From all matches to the disjoint ones that count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CLOSE, OPEN, literal
from ..functions.validators import apply, bind

MATCH = (
    "struct<start:int,end:int,value:string,confidence:double,detector:string,priority:int,risk:string,type:string,entity:int,part:string>"
)


def above(found: Column, least: float) -> Column:
    return F.filter(found, lambda m: m["confidence"] >= least) if least > 0 else found


def without_allowed(found: Column, allowlist: tuple[str, ...]) -> Column:
    """Without matches that equal a term, or hold one of three or more characters as a whole word."""
    if not allowlist:
        return found
    exact = sorted({a.lower() for a in allowlist})
    longer = [literal(a) for a in allowlist if len(a) >= 3]
    inside = f"(?iu){OPEN}(?:{'|'.join(longer)}){CLOSE}"

    def kept(m: Column) -> Column:
        ok = ~F.lower(m["value"]).isin(*exact)
        return ok & ~m["value"].rlike(inside) if longer else ok

    return F.filter(found, kept)


def winners(spans: list[tuple[int, int, int, float]]) -> list[int]:
    """Places in ``spans`` (start, end, priority, confidence) of those that stay, by start.

    Of spans that overlap the one of higher priority stays, then the longer, the surer, the earlier, and the one found
    first; a span is only shut out by one that stays. The characters taken are marks, so that a span is tested by one search over
    its own length.
    """
    taken = bytearray(max((s[1] for s in spans), default=0))
    kept = []
    for i in sorted(range(len(spans)), key=lambda i: (-spans[i][2], spans[i][0] - spans[i][1], -spans[i][3], spans[i][0], i)):
        start, end = spans[i][:2]
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            kept.append(i)
    return sorted(kept, key=lambda i: spans[i][:2])


def resolve_overlaps(df: DataFrame, matches_col: str) -> DataFrame:
    """``df`` with disjoint matches by start. Rows without an overlap are only sorted; the others send the places of their
    matches, no texts, through ``winners``."""

    def run(places: pd.DataFrame) -> pd.Series:
        out = []
        for s, e, p, c in zip(places["start"], places["end"], places["priority"], places["confidence"], strict=True):
            if s is None:
                out.append(None)
                continue
            stay = [False] * len(s)
            for i in winners(list(zip(s.tolist(), e.tolist(), p.tolist(), c.tolist(), strict=True))):
                stay[i] = True
            out.append(stay)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"places": pd.DataFrame, "return": pd.Series}
    # a generator of one row ends the projection: the optimizer doesn't move the test into the function's arguments
    others = [c for c in df.columns if c != matches_col]
    at = F.struct(overlapping(F.col(matches_col)).alias("busy"), F.col(matches_col).alias("m"))
    own = df.select(*others, F.explode(F.array(at)).alias("_vf_at")).select(*others, F.col("_vf_at.m").alias(matches_col), F.col("_vf_at.busy").alias("_vf_busy"))
    found = F.col(matches_col)
    parts = [found[f].alias(f) for f in ("start", "end", "priority", "confidence")]
    stay = F.pandas_udf(run, "array<boolean>")(F.when(F.col("_vf_busy"), F.struct(*parts)))
    # zipped, not looked up: a Python function can't stand inside a lambda
    chosen = F.expr(f"transform(filter(arrays_zip({matches_col}, _vf_stay), z -> z._vf_stay), z -> z.{matches_col})")
    kept = F.array_sort(F.when(F.col("_vf_stay").isNotNull(), chosen).otherwise(found))
    return own.withColumn("_vf_stay", stay).select(*others, kept.alias(matches_col))


def overlapping(found: Column) -> Column:
    """Whether any two matches overlap: only these rows need more than a sort."""
    ends = "sort_array(transform(_a.m, m -> named_struct('s', m.start, 'e', m.end)))"
    neighbours = "size(filter(o, (x, i) -> i > 0 and get(o, i - 1).e > x.s)) > 0"
    return apply(bind("o", ends, neighbours), m=found)
