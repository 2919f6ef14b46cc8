"""Places of templates that were left open in a text."""

from __future__ import annotations

import re

# Forms that hardly stand for anything but a template's place.
CERTAIN = (
    r"\$\{\s*[^\W\d][\w. ]*\}",
    r"\{\{[^{}\n]+\}\}",
    r"\{%[^%\n]+%\}",
    r"<%[^%\n]+%>",
    r"<<\s*[^\W\d][\w .-]*>>",
    r"@@[^\W\d][\w.-]*@@",
    r"##[^\W\d][\w.-]*##",
    r"(?<![\w#])#[^\W\d]\w*#(?![\w#])",
    r"(?i:\[(?:insert|enter|fill in|your)\b[^\]\n]*\])",
    r"(?i:\[[^\]\n]{1,60}\bhere\])",
)
# Forms that mean other things as well.
POSSIBLE = (
    r"\[\[\s*[^\W\d][\w.-]*\s*\]\]",
    r"(?<![\w_])__[^\W\d_]\w*?__(?![\w_])",
    r"(?<![\w%])%[A-Z][A-Z_]+%(?![\w%])",
    r"(?<![\w{$%])\{[^\W\d]\w*\}(?!\})",
    r"(?<![\w<])<[A-Z][A-Z_]+>(?!>)",
    r"(?<![\w$])\$[a-z]+(?:_[a-z]+)+\b",
    r"(?<![\w'\"])(?:X{2,4}|TBD|TODO|TBA|FIXME)(?![\w'\"])",
    r"(?<![\w'\"?])\?{3,}",
)
MAY_HOLD = re.compile(r"[\[{<%_@#$]|XX|TBD|TODO|TBA|FIXME|\?\?\?")
_CERTAIN = re.compile("|".join(CERTAIN))
_POSSIBLE = re.compile("|".join(POSSIBLE))
# Words right before a place, or right behind it, of sentences that speak of the place itself.
_BEFORE = re.compile(
    r"(?:\b(?:replac\w+|substitut\w+|placeholders?|variables?|macros?|templates?|tags?|tokens?|(?:quoted|written|shown|printed|spelled|marked|given|known) as|"
    r"paths? with|such as|called|named|syntax|notation|platzhalter|vorlage|ersetzt|remplac\w+|modèle|plantilla|reempla\w+|sustitu\w+)\W{1,3}|[\"'`\u201C\u2018\u00AB]\s?)$",
    re.IGNORECASE,
)
_BEHIND = re.compile(
    r"^(?:[\"'`\u201D\u2019\u00BB]|\W{0,2}(?:stands? for|means?|denotes?|(?:is|are) (?:replaced|filled|the|a|an)?\s?(?:by|with|in|placeholders?)|marks? (?:a|the)|steht für|désigne|significa)\b)",
    re.IGNORECASE,
)


def mentioned(sentence: str, spans: list[tuple[int, int]]) -> bool:
    """Whether the sentence speaks of one of its places, instead of having it left open: quoted, or named as what it is."""
    return any(_BEFORE.search(sentence[max(0, a - 40) : a]) or _BEHIND.match(sentence[b : b + 40]) for a, b in spans)


def open_places(sentence: str) -> tuple[int, set[str]]:
    """How many certain places the sentence leaves open, and the texts of possible ones, without blanks and in lower case."""
    certain = [m.span() for m in _CERTAIN.finditer(sentence)]
    rest = _CERTAIN.sub(lambda m: " " * len(m.group()), sentence) if certain else sentence
    possible = [m.span() for m in _POSSIBLE.finditer(rest)]
    if not certain and not possible or mentioned(sentence, certain + possible):
        return 0, set()
    return len(certain), {re.sub(r"\s", "", sentence[a:b]).lower() for a, b in possible}
