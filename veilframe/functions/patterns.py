"""Pieces of regular expressions in Java's dialect, and spans by rules as one array expression.

Java's ``\\b`` is Unicode-aware and its ``\\s`` ASCII-only; the rules here need the
opposite, so both are spelled out. Java's matcher recurses on a repeated group that may
give back what it took: a group that may repeat often is possessive, or its count bounded
by the format.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import apply, bind, quoted

#: White space as Unicode has it; ``WS`` is a class, ``WSC`` its inside.
WSC = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WSC}]"
#: An ASCII word character, and the places without one before or after.
W = "[A-Za-z0-9_]"
LEFT, RIGHT = f"(?<!{W})", f"(?!{W})"
#: No letter, digit or underscore of any script on that side.
OPEN, CLOSE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

SPAN = "struct<start:int,end:int,value:string,confidence:double>"
#: Matches looked back over for the text before a match: a hint's window over the shortest match and a gap.
_BACK, _WIDEST = 10, 64


def literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return "".join("\\" + c if c in r"\.*+?^${}()|[]&-#~" else c for c in text)


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def running_sum(values: str) -> str:
    """SQL: for each element of an array of longs the sum up to it, within blocks of root n elements and over the blocks' sums.

    A fold copies what it has at each step, so it only ever runs over a block.
    """
    none = "cast(array() as array<bigint>)"
    size = "cast(ceil(sqrt(size(rv))) as int)"
    block = f"aggregate(slice(rv, rb * rn + 1, rn), {none}, (ra, rx) -> concat(ra, array(rx + coalesce(get(ra, size(ra) - 1), 0L))))"
    blocks = bind("rn", size, f"transform(sequence(0, cast(ceil(size(rv) / rn) as int) - 1), rb -> {block})")
    ahead = f"aggregate(rf, array(0L), (ra, rx) -> concat(ra, array(element_at(rx, -1) + get(ra, size(ra) - 1))))"
    joined = bind("ro", ahead, "flatten(transform(rf, (ry, ri) -> transform(ry, rx -> rx + get(ro, ri))))")
    return bind("rv", values, f"if(size(rv) = 0, {none}, {bind('rf', blocks, joined)})")


@dataclass(frozen=True)
class Shape:
    """What one kind of match looks like.

    ``lead``: the pattern is (lead)(value), and the value is the span; otherwise the whole match is.
    ``needs``: lower-case texts of which every text with a match holds one in some case; ``quick``: a cheap
    pattern that it matches. ``check``: the name of a test in ``CHECKS``; a value that fails it is dropped and not
    searched again. ``hint``: words of which one must stand within ``window`` characters before.
    ``trim``: whether punctuation at the value's end is left out.
    """

    pattern: str
    confidence: float = 1.0
    needs: tuple[str, ...] = ()
    quick: str = ""
    lead: bool = False
    check: str = ""
    hint: tuple[str, ...] = ()
    window: int = 0
    trim: bool = False


#: Tests of a match by name, as SQL text of (the value, the text before it, the words to leave out).
CHECKS: dict[str, Callable[[str, str, frozenset], str]] = {}
#: Those that look at the text before a match.
LOOK_BACK = {"ipv4"}


def hint_pattern(words: Iterable[str]) -> str:
    """One of the words, whole. The edge of the text searched counts as a word's."""
    return f"(?:\\A|[^a-z0-9])(?:{'|'.join(literal(w) for w in words)})(?![a-z0-9])"


def gate(shape: Shape, text: str = "t", low: str = "l", quick: str | None = None) -> str:
    """SQL: whether the text has a match, the cheap tests first. ``quick`` stands for that test where it is known already."""
    tests = []
    if shape.needs:
        tests.append("(" + " or ".join(f"contains({low}, {quoted(n)})" for n in shape.needs) + ")")
    if quick or shape.quick:
        tests.append(quick or f"{text} rlike {quoted(shape.quick)}")
    return " and ".join([*tests, f"{text} rlike {quoted(shape.pattern)}"])


def _found(shapes: list[Shape], words: frozenset) -> str:
    """SQL: the spans of rule ``r`` in text ``t``, which has a match.

    The gaps of ``split`` and the matches of ``regexp_extract_all`` come from the same left-to-right
    search, so the sum of all lengths up to a match is its end in code points. No step looks
    at the text from its start again.
    """
    whole, lead = "regexp_extract_all(t, r.pattern, 0)", "''"
    given = f"named_struct('h', {whole}, 'g', split(t, r.pattern, -1))"
    if any(s.lead for s in shapes):
        given = (
            f"named_struct('h', if(r.lead, regexp_extract_all(t, r.pattern, 2), {whole}), 'g', split(t, r.pattern, -1), "
            "'d', if(r.lead, regexp_extract_all(t, r.pattern, 1), cast(array() as array<string>)))"
        )
        lead = "coalesce(get(x.d, i), '')"
    zipped = f"transform(x.h, (h, i) -> named_struct('gap', get(x.g, i), 'lead', {lead}, 'hit', h))"
    ends = running_sum("transform(z, p -> cast(length(p.gap) + length(p.lead) + length(p.hit) as bigint))")
    checks = sorted({s.check for s in shapes} - {""})
    hinted = any(s.hint for s in shapes)
    ahead, pieces = "''", "0"
    if hinted or LOOK_BACK & set(checks):
        pieces = f"transform(z, p -> concat(right(p.gap, {_WIDEST}), p.lead, p.hit))"
        earlier = f"array_join(slice(k, greatest(i - {_BACK}, 0) + 1, least(i, {_BACK})), '')"
        ahead = f"lower(right(concat({earlier}, right(p.gap, {_WIDEST}), p.lead), {_WIDEST}))"
    value = f"if(r.trim, {trim_sql('p.hit')}, p.hit)" if any(s.trim for s in shapes) else "p.hit"
    placed = f"transform(z, (p, i) -> named_struct('a', cast(get(e, i) - length(p.hit) as int), 'v', {value}, 'ahead', {ahead}))"
    good = "length(m.v) > 0"
    if hinted:
        good += " and (r.window = 0 or right(m.ahead, r.window) rlike r.hint)"
    if checks:
        good += " and case r.check when '' then true " + " ".join(f"when {quoted(c)} then {CHECKS[c]('m.v', 'm.ahead', words)}" for c in checks) + " end"
    done = f"transform(filter({placed}, m -> coalesce({good}, false)), m -> named_struct('start', m.a, 'end', m.a + length(m.v), 'value', m.v, 'confidence', r.confidence, 'rule', r.fields))"
    return bind("x", given, bind("z", zipped, bind("e", ends, bind("k", pieces, done))))


def _constant(value: object) -> str:
    return quoted(value) if isinstance(value, str) else str(value)


def rule_sql(text: str, rules: list[tuple[Shape, tuple]], words: frozenset = frozenset()) -> str:
    """SQL: spans of all rules in their order, each with the rule's own fields: array<struct<start,end,value,confidence,rule>>.

    ``rules``: (shape, fields), the fields constants that become f0, f1, ... Every pattern is tried by its gate, where it is compiled once a
    task, and a cheap test that shapes share is made once a text; places are worked out by one expression, for the rules that have a match.
    The whole is one text of SQL, as building as many columns takes longer than to scan a small table.
    """
    shapes = [s for s, _ in rules]
    table = ", ".join(
        f"named_struct('pattern', {quoted(s.pattern)}, 'confidence', {float(s.confidence)}D, 'lead', {str(s.lead).lower()}, 'check', {quoted(s.check)}, "
        f"'hint', {quoted(hint_pattern(s.hint) if s.hint else '')}, 'window', {s.window}, 'trim', {str(s.trim).lower()}, "
        f"'fields', named_struct({', '.join(f"'f{n}', {_constant(v)}" for n, v in enumerate(fields))}))"
        for s, fields in rules
    )
    shared = sorted(q for q, times in Counter(s.quick for s in shapes).items() if q and times > 1)
    tests = {q: f"q.b{n}" for n, q in enumerate(shared)}
    gates = ", ".join(f"if({gate(s, quick=tests.get(s.quick))}, {i}, null)" for i, s in enumerate(shapes))
    own = bind("r", f"get(array({table}), j)", _found(shapes, words))
    found = f"flatten(transform(filter(array({gates}), j -> j is not null), j -> {own}))"
    if shared:
        found = bind("q", "named_struct(" + ", ".join(f"'b{n}', t rlike {quoted(q)}" for n, q in enumerate(shared)) + ")", found)
    return bind("t", f"coalesce({text}, '')", bind("l", "lower(t)", found))


def rule_spans(text: Column, rules: list[tuple[Shape, tuple]], words: frozenset = frozenset()) -> Column:
    return apply(rule_sql("_a.t", rules, words), t=text)


def spans(text: Column, *shapes: Shape, words: frozenset = frozenset()) -> Column:
    """array<SPAN> of the shapes in ``text``; never null."""
    found = rule_spans(text, [(s, (0,)) for s in shapes], words)
    return F.call_function("transform", found, F.expr("m -> named_struct('start', m.start, 'end', m.end, 'value', m.value, 'confidence', m.confidence)"))


def trim_sql(v: str) -> str:
    ends = r""".,;:!?'"\x{BB})\]}"""
    count = lambda of, c: f"length({of}) - length(replace({of}, '{c}', ''))"
    # parentheses of the tail that still balance: as many as are open after the core
    kept = f"least({count('ta', ')')}, greatest({count('co', '(')} - ({count('co', ')')}), 0))"
    held = bind("ke", kept, f"if(ke > 0, regexp_substr(ta, concat({quoted('\\A(?:[^)]*+\\)){')}, ke, '}}+')), '')")
    core = bind("co", f"left({v}, length({v}) - length(ta))", f"concat(co, {held})")
    return bind("ta", f"coalesce(regexp_substr({v}, {quoted(f'(?<![{ends}])[{ends}]++\\z')}), '')", core)


def trim_trailing(value: Column) -> Column:
    """A URL without the punctuation after it. A closing parenthesis that the URL opened stays, and so
    does what stands before it."""
    return apply(trim_sql("_a.v"), v=value)
