"""Options of detection and redaction, settled when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES, STYLES = ("token", "pseudonym"), {"bracket": ("[", "]"), "curly": ("{{", "}}"), "angle": ("<", ">"), "bare": ("", "")}


@dataclass(frozen=True)
class Rule:
    """A rule of the user's: a literal (whole words, any case) or a regular expression."""

    label: str
    pattern: str
    kind: str = "literal"
    flags: str = ""
    risk: str = "high"


@dataclass(frozen=True)
class Lexicon:
    """Words in lower case by which person names are told; see ``veilframe.functions.lexicon``."""

    given: frozenset[str]
    surnames: frozenset[str]
    stopwords: frozenset[str]


@dataclass(frozen=True)
class Options:
    """``enabled``: ids of detectors, None for the default ones; an empty tuple leaves rules and columns on."""

    enabled: tuple[str, ...] | None = None
    mode: str = "token"
    style: str = "bracket"
    aggressive_names: bool = False
    structure_aware: bool = True
    allowlist: tuple[str, ...] = ()
    custom_rules: tuple[Rule, ...] = ()
    salt: str = ""
    min_confidence: float = 0.0
    lexicon: Lexicon | None = field(default=None, repr=False)

    def normalised(self) -> Options:
        """With safe values where unknown ones were given."""
        return Options(
            None if self.enabled is None else tuple(self.enabled),
            self.mode if self.mode in MODES else "token", self.style if self.style in STYLES else "bracket",
            bool(self.aggressive_names), self.structure_aware is not False,
            tuple(s for s in (str(a).strip() for a in self.allowlist or ()) if s), tuple(self.custom_rules or ()), self.salt or "",
            float(self.min_confidence) if isinstance(self.min_confidence, (int, float)) else 0.0, self.lexicon,
        )


def styled(body: str, style: str) -> str:
    left, right = STYLES[style]
    return f"{left}{body}{right}"
