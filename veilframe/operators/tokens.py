"""Tokens or pseudonyms for the matches of one document, and the text with them in place.

Numbers follow the order of appearance, so this is a Python function on the rows
that have a match. A token is never one that the document already holds. Every step is
one walk over the text or over the matches, whatever their number.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import regex

from ..options import STYLES, Options, styled

ENTRY = "struct<token:string,body:string,value:string,type:string,detector:string,risk:string,confidence:double,count:int>"
RESULT = f"struct<redacted:string,entries:array<{ENTRY}>,tokens:array<struct<token:string,body:string>>,error:string>"
ATTEMPTS = 64

# Words of our own for pseudonyms.
_FIRST = "Aldis Brenna Corwin Delphi Edlyn Faron Gilda Hadrian Isolde Jorah Kelda Lorne Mirela Nerys Orrin Petra Quillan Rhoswen Stellan Thora".split()
_LAST = "Ashgrove Birchmere Copperfell Dunwick Elmsworth Foxholt Greymoor Hartwell Ivydale Kingsmere Larkfield Marshgate Northlea Oxbourne Pinecrest".split()
_FIRMS, _TRADES = "Bluepeak Cloverfield Duskwater Emberline Fernhollow Goldcrest Heronsgate".split(), "Works Supply Studios Foundry Freight Studio Trading".split()
_ROADS = "Amber Bracken Clover Dover Ember Fennel Garnet Heather".split()
# Card numbers that issuers publish for tests.
_CARDS = ("4111 1111 1111 1111", "4012 8888 8888 1881", "5555 5555 5555 4444", "5105 1051 0510 5100", "3782 822463 10005", "6011 1111 1111 1117")
_RUN = re.compile(r"[A-Za-z0-9_]+")


def hash32(text: str) -> int:
    """FNV-1a of the UTF-16 units."""
    h = 2166136261
    raw = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return h


# ---------------------------------------------------------------- pseudonyms
# A maker draws from a generator seeded by the value; numbers come from what is kept for documentation and tests:
# RFC 2606 names, RFC 5737 and RFC 7042 addresses, 555-01xx telephones, Social Security areas from 900 that are never given out.


def _mail(r, value):
    return f"{r.choice(_FIRST)}.{r.choice(_LAST)}@example.{r.choice(('com', 'org', 'net'))}".lower()


def _bank_account(r, value):
    body = f"TEST{r.randrange(10**14):014d}"
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}GB00")) % 97
    return f"GB{check:02d}{body}"


def _day(r, value):
    return f"{r.randrange(1950, 2006)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"


def _link(r, value):
    return f"https://example.{r.choice(('com', 'org'))}/page/{r.randrange(10**6)}"


MAKERS = {
    "EMAIL": _mail, "IBAN": _bank_account, "DATE": _day, "DATE_OF_BIRTH": _day, "URL": _link, "URL_WITH_SECRET": _link,
    "ORG": lambda r, v: f"{r.choice(_FIRMS)} {r.choice(_TRADES)}",
    "PHONE": lambda r, v: f"+1 {r.randrange(201, 990)} 555-01{r.randrange(100):02d}",
    "CARD_EXPIRY": lambda r, v: f"{r.randrange(1, 13):02d}/{r.randrange(30, 40)}",
    "CVV": lambda r, v: str(r.randrange(10**9))[-(4 if sum(map(str.isdigit, v)) == 4 else 3) :].zfill(3),
    "SSN": lambda r, v: f"{r.randrange(900, 1000)}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}",
    "CREDIT_CARD": lambda r, v: r.choice(_CARDS),
    "ADDRESS": lambda r, v: f"{r.randrange(1, 1000)} {r.choice(_ROADS)} Street",
    "POSTAL_CODE": lambda r, v: f"{r.randrange(99951, 100000)}",
    "IP_ADDRESS": lambda r, v: f"{r.choice(('192.0.2', '198.51.100', '203.0.113'))}.{r.randrange(1, 255)}",
    "MAC_ADDRESS": lambda r, v: f"00:00:5e:00:53:{r.randrange(256):02x}",
    "HOSTNAME": lambda r, v: f"node{r.randrange(10**5)}.example.test",
    "SOCIAL_HANDLE": lambda r, v: f"someone{r.randrange(10**6)}",
}


class Faker:
    """Made-up values, each used once and none of them in the document. Equal salts, types and values give equal ones."""

    def __init__(self, salt: str, source: str, used: set[str] = frozenset()):
        self.salt, self.source, self.used = salt, source, set(used)
        self.people: dict[object, tuple[str, str]] = {}
        self.words: set[str] | None = None

    def person(self, who: object, seed: str) -> tuple[str, str]:
        if who not in self.people:
            r = random.Random(hash32(f"{self.salt}\0{seed}"))
            self.people[who] = r.choice(_FIRST), r.choice(_LAST)
        return self.people[who]

    def free(self, made: str) -> bool:
        """Whether nobody has a value and the text doesn't hold it. Most have a word that the text hasn't, and need no search."""
        if made in self.used:
            return False
        if self.words is None:
            self.words = set(re.findall(r"\w+", self.source))
        return not set(re.findall(r"\w+", made)) <= self.words or made not in self.source

    def __call__(self, kind: str, value: str, entity: int | None = None, part: str | None = None) -> str:
        seed, made = hash32(f"{self.salt}{kind}{value}"), ""
        for n in range(ATTEMPTS):
            made = self.made(kind, value, random.Random(seed + n * 0x9E3779B1), n, entity, part)
            if self.free(made):
                break
        else:
            made = f"{made}-{len(self.used) + 1}"
            while not self.free(made):
                made += "x"
        self.used.add(made)
        return made

    def made(self, kind: str, value: str, r: random.Random, n: int, entity: int | None, part: str | None) -> str:
        again = str(n + 1) if n else ""
        if kind == "PERSON":
            first, last = self.person(("alone", value) if entity is None else entity, value)
            return " ".join(w + again for w, p in ((first, "first"), (last, "last")) if part in (p, "full", None))
        if kind == "EMAIL" and entity is not None:
            return f"{'.'.join(self.person(entity, value))}{again}@example.com".lower()
        if kind in MAKERS:
            return MAKERS[kind](r, value)
        return f"{re.sub('[^a-z0-9]+', '-', kind.lower()).strip('-')}-{r.randrange(10**6):06d}"


# ---------------------------------------------------------------- tokens


def number_of(body: str) -> int:
    """The number at which a body's counter stands."""
    m = re.search(r"_(\d+)(?:_|\Z)", body)
    return int(m[1]) if m else 0


class Numbers:
    """Bodies of tokens that neither an entry nor the text has: ``TYPE_n``, and ``PERSON_n`` with a part for a person."""

    def __init__(self, text: str, entries, floors: dict[str, int]):
        # a body in the text counts as taken only where restoring would take it for a token: alone, in any case
        self.taken = {w.lower() for w in _RUN.findall(text) if "_" in w} | {e["body"].lower() for e in entries}
        self.last: dict[str, int] = defaultdict(int, floors)
        for e in entries:
            self.last[e["type"]] = max(self.last[e["type"]], number_of(e["body"]))
        self.people: dict[int, int] = {}

    def claim(self, body: str) -> bool:
        free = body.lower() not in self.taken
        self.taken.add(body.lower())
        return free

    def next(self, kind: str, entity: int | None, part: str | None) -> str:
        if kind == "PERSON" and entity is not None:
            return self.for_person(entity, part)
        while True:
            self.last[kind] += 1
            if self.claim(body := f"{kind}_{self.last[kind]}"):
                return body

    def for_person(self, entity: int, part: str | None) -> str:
        if entity not in self.people:
            self.last["PERSON"] += 1
            self.people[entity] = self.last["PERSON"]
        stem = f"PERSON_{self.people[entity]}" + {"first": "_FIRSTNAME", "last": "_LASTNAME"}.get(part or "", "")
        body, n = stem, 1
        while not self.claim(body):
            n += 1
            body = f"{stem}_{n}"
        return body


def spliced(text: str, places: list[tuple[int, int]], tokens: list[str]) -> str:
    """The text with a token at each of the disjoint places, which are by start."""
    edges = [0, *(x for p in places for x in p), len(text)]
    kept = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return "".join(x for pair in zip(kept, [*tokens, ""], strict=True) for x in pair)


def _owner(m: dict, by_part: dict[str, int]) -> int | None:
    """The person that a match belongs to: its own, or of an address or handle the one whose name it holds."""
    if m["entity"] is not None or m["type"] not in ("EMAIL", "SOCIAL_HANDLE"):
        return m["entity"]
    local = m["value"].partition("@")[0].lower()
    words = [w for w in regex.split(r"[^\p{L}]+", local) if w]
    exact = next((by_part[w] for w in words if w in by_part), None)
    return exact if exact is not None else next((who for part, who in by_part.items() if part in local), None)


def assign(
    text: str, found: list[dict], options: Options, seed: list[dict] | None = None, floors: dict[str, int] | None = None,
) -> tuple[str, list[dict], list[tuple[str, str]]]:
    """The text with tokens in place, the vault's entries, and the (token, body) of each match.

    ``found``: disjoint matches by start. ``seed``: entries of an earlier vault, whose tokens stay theirs. ``floors``: numbers
    by type that earlier documents have used up.
    """
    entries = {(e["type"], e["value"]): {**e, "count": 0} for e in seed or ()}
    firsts: dict[tuple[str, str], dict] = {}
    for m in found:
        firsts.setdefault((m["type"], m["value"]), m)
    times = Counter((m["type"], m["value"]) for m in found)
    numbers = Numbers(text, entries.values(), floors or {})
    fake, by_part = None, {}
    if options.mode == "pseudonym":
        fake = Faker(options.salt, text, {e["token"] for e in entries.values()})
        named = (m for m in found if m["type"] == "PERSON" and m["entity"] is not None)
        by_part = {w.lower(): m["entity"] for m in named for w in regex.split(r"[^\p{L}]+", m["value"]) if len(w) >= 3}
    for key, m in firsts.items():
        if key not in entries:
            body = numbers.next(m["type"], m["entity"], m["part"])
            token = fake(m["type"], m["value"], _owner(m, by_part), m["part"]) if fake else styled(body, options.style)
            entries[key] = {k: m[k] for k in ("value", "type", "detector", "risk", "confidence")} | {"token": token, "body": body, "count": 0}
        entries[key]["count"] = times[key]
    for m in found:
        entry = entries[m["type"], m["value"]]
        entry["confidence"] = max(entry["confidence"], m["confidence"])
    own = [entries[m["type"], m["value"]] for m in found]
    out = spliced(text, [(m["start"], m["end"]) for m in found], [e["token"] for e in own])
    return out, list(entries.values()), [(e["token"], e["body"]) for e in own]


# ---------------------------------------------------------------- restoring


def _put_back_tokens(text: str, said: dict[str, dict], style: str) -> tuple[str, Counter]:
    """Every run of word characters that is a body, with the style's marks around it or bare, in any case."""
    left, right = (re.escape(s) for s in STYLES.get(style, ("", "")))
    dress = rf"(?P<open>{left}\s*+)?(?P<body>(?<![A-Za-z0-9_])[A-Za-z0-9_]++)(?P<close>\s*+{right})?" if left else r"(?P<open>)(?P<body>[A-Za-z0-9_]++)(?P<close>)"
    hits: Counter = Counter()

    def back(m) -> str:
        key = m["body"].lower()
        if key not in said:
            return m[0]
        hits[key] += 1
        value = said[key]["value"]
        return value if m["open"] and m["close"] else f"{m['open'] or ''}{value}{m['close'] or ''}"

    return re.sub(dress, back, text), hits


def _put_back_values(text: str, said: dict[str, dict]) -> tuple[str, Counter]:
    """Every pseudonym that stands alone, the longest first where several begin: found by its first word and its length."""
    atom = re.compile(r"\w+|[^\w\s]")
    lengths: dict[str, set[int]] = defaultdict(set)
    for token in said:
        if m := atom.search(token):
            lengths[m[0]].add(len(token) - m.start())
    heads = {a: sorted(n, reverse=True) for a, n in lengths.items()}
    by_rest = {token[m.start() :]: token for token in said if (m := atom.search(token))}
    hits: Counter = Counter()
    out, done = [], 0
    for m in atom.finditer(text):
        at = m.start()
        if at < done or m[0] not in heads or (at and re.match(r"\w", text[at - 1])):
            continue
        for n in heads[m[0]]:
            token = by_rest.get(text[at : at + n])
            if token is not None and not (at + n < len(text) and re.match(r"\w", text[at + n])):
                hits[token] += 1
                out += [text[done:at], said[token]["value"]]
                done = at + n
                break
    return "".join([*out, text[done:]]), hits


def restore(text: str | None, entries: list[dict], mode: str, style: str) -> tuple[str, int, list[tuple], list[tuple]]:
    """The text with the values back, how many, and (token, value, type, count) and (token, type) of those found and not.

    One pass, so what is put back is never searched again.
    """
    text, said = text or "", {}
    for e in entries:
        said.setdefault(e["token"] if mode == "pseudonym" else e["body"].lower(), e)
    hits: Counter = Counter()
    if said:
        text, hits = _put_back_values(text, said) if mode == "pseudonym" else _put_back_tokens(text, said, style)
    restored = [(e["token"], e["value"], e["type"], hits[k]) for k, e in said.items() if hits[k]]
    return text, sum(hits.values()), restored, [(e["token"], e["type"]) for k, e in said.items() if not hits[k]]
