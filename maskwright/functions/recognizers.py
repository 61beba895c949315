"""Recognizers: what counts as personal data when a pattern can tell.

Patterns are Java regular expressions in explicit ASCII classes, must not match the empty
string, and must not backtrack over long runs. ``family`` names a cheap test that is made
once per text for all its recognizers. Names, places and organisations are not patterns:
see ``operators.dictionary`` and ``operators.models``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from maskwright.functions.spans import SPAN, empty, let, located, quoted

CONTEXT_WINDOW = 40

_LEFT = "(?<![0-9A-Za-z_])"
_RIGHT = "(?![0-9A-Za-z_])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL = r"\p{L}\p{M}\p{N}._%+-"
_URL_BODY = r'[^\x00-\x20<>"]'
_URL_END = r"""[^\x00-\x20<>".,;:!?')\]}]"""

FAMILIES: dict[str, str] = {
    "at": "contains({text}, '@')",
    "scheme": "contains({text}, '://')",
    "www": "contains(lower({text}), 'www.')",
    "digits": "{text} RLIKE '[0-9]'",
    "colons": "contains({text}, ':') AND {text} RLIKE " + quoted(r"[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|::[0-9A-Fa-f]"),
    "any": "{text} IS NOT NULL",
}


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    pattern: str
    score: float
    family: str = "any"
    check: str | None = None
    context: str | None = None
    context_score: float | None = None

    def __post_init__(self) -> None:
        # A marker can only be read back if its type is made of these characters.
        if not re.fullmatch(r"[A-Z_]+", self.entity_type):
            raise ValueError(f"entity type {self.entity_type!r} must match [A-Z_]+")
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family!r}")


# Checks are SQL conditions with ``{match}`` for the matched text (braces doubled).
_DIGITS = "regexp_replace({match}, '[^0-9]', '')"

LUHN_OK = f"luhn_check({_DIGITS})"

# Area, group and serial numbers that were never issued are refused.
SSN_OK = f"NOT ({_DIGITS} RLIKE '^(000|666|9)|^[0-9]{{{{3}}}}00|0000$')"

# Country code and check digits to the end, letters as 10..35, remainder 1 by 97.
IBAN_OK = (
    "length(replace({match}, ' ', '')) BETWEEN 15 AND 34 AND aggregate("
    "transform(split(substring(replace({match}, ' ', ''), 5) || substring(replace({match}, ' ', ''), 1, 4),"
    " '(?!^)(?!$)', -1), ch -> CAST(conv(ch, 36, 10) AS int)),"
    " 0, (rest, v) -> (rest * if(v > 9, 100, 10) + v) % 97) = 1"
)

# Ten digits times 10 down to 1 add up to a multiple of 11.
NHS_OK = (
    f"aggregate(sequence(1, 10), 0, (acc, k) -> acc + CAST(substring({_DIGITS}, k, 1) AS int) * (11 - k)) % 11 = 0"
)

_SSN_CONTEXT = r"(?i)ssn|social security|social sec"

RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer(
        "EMAIL_ADDRESS",
        # A run of local-part characters is tried from its first character only (or from
        # where the match before ended), which keeps long runs linear.
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[\p{{L}}\p{{M}}\p{{N}}.-]+\.[\p{{L}}]{{2,}}",
        1.0,
        "at",
    ),
    Recognizer(
        "PHONE_NUMBER",
        r"(?<![0-9A-Za-z_+])(?:"
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
        r"|(?:1[ .-])?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
        r"|(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
        rf"){_RIGHT}",
        0.4,
        "digits",
        context=r"(?i)phone|tel[.:]|call|mobile|cell|fax",
        context_score=0.75,
    ),
    Recognizer(
        "CREDIT_CARD",
        rf"{_LEFT}(?:[2-6][0-9]{{12,18}}"
        r"|[2-6][0-9]{3}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}"
        rf"|3[0-9]{{3}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_RIGHT}",
        1.0,
        "digits",
        check=LUHN_OK,
    ),
    Recognizer(
        "US_SSN",
        rf"{_LEFT}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_RIGHT}",
        0.5,
        "digits",
        check=SSN_OK,
        context=_SSN_CONTEXT,
        context_score=0.85,
    ),
    Recognizer(
        "US_SSN",
        rf"{_LEFT}[0-9]{{9}}{_RIGHT}",
        0.05,
        "digits",
        check=SSN_OK,
        context=_SSN_CONTEXT,
        context_score=0.4,
    ),
    Recognizer(
        "US_ITIN",
        rf"{_LEFT}9[0-9]{{2}}-(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])-[0-9]{{4}}{_RIGHT}",
        0.5,
        "digits",
    ),
    Recognizer(
        "IBAN_CODE",
        rf"{_LEFT}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_RIGHT}",
        1.0,
        "digits",
        check=IBAN_OK,
    ),
    Recognizer("IP_ADDRESS", rf"{_LEFT}(?:{_OCTET}\.){{3}}{_OCTET}{_RIGHT}", 0.6, "digits"),
    Recognizer(
        "IP_ADDRESS",
        r"(?<![0-9A-Za-z_:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
        r"|(?:[0-9A-Fa-f]{1,4}:){2,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7})(?![0-9A-Za-z_:])",
        0.6,
        "colons",
        check="size(split({match}, ':')) <= 9 AND (size(split({match}, ':')) <= 8 OR {match} LIKE '::%' OR {match} LIKE '%::') AND {match} RLIKE '[0-9]'",
    ),
    Recognizer("URL", rf"https?://{_URL_BODY}*{_URL_END}", 0.6, "scheme"),
    Recognizer("URL", rf"(?<![0-9A-Za-z_./@-])(?i:www)\.[0-9A-Za-z-]+\.{_URL_BODY}*{_URL_END}", 0.5, "www"),
    Recognizer(
        "PHONE_NUMBER",
        # ten bare digits say nothing by themselves
        rf"{_LEFT}[2-9][0-9]{{9}}{_RIGHT}",
        0.05,
        "digits",
        context=r"(?i)phone|tel[.:]|call|mobile|cell|fax",
        context_score=0.5,
    ),
    Recognizer(
        "DATE_TIME",
        rf"{_LEFT}(?:[12][0-9]{{3}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[T ][0-2][0-9]:[0-5][0-9](?::[0-5][0-9])?Z?)?"
        r"|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./][12][0-9]{3}"
        r"|(?:0?[1-9]|1[0-2])/(?:1[3-9]|2[0-9]|3[01])/[12][0-9]{3}"
        rf"){_RIGHT}",
        0.6,
        "digits",
    ),
    Recognizer("CRYPTO", rf"{_LEFT}(?:bc1[02-9ac-hj-np-z]{{25,59}}|0x[0-9A-Fa-f]{{40}}){_RIGHT}", 0.6, "digits"),
    Recognizer("UK_NHS", rf"{_LEFT}[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{4}}{_RIGHT}", 0.3, "digits", NHS_OK, r"(?i)nhs|national health", 0.85),
)


def select_recognizers(
    entities: Iterable[str] | None = None, recognizers: Iterable[Recognizer] = RECOGNIZERS
) -> tuple[Recognizer, ...]:
    """The recognizers of the wanted entity types; all of them if none is named."""
    wanted = set(entities or ())
    chosen = tuple(r for r in recognizers if not wanted or r.entity_type in wanted)
    missing = wanted - {r.entity_type for r in chosen}
    if missing:
        raise ValueError(f"no recognizer for {', '.join(sorted(missing))}")
    return chosen


def recognized(
    text: str, recognizers: Iterable[Recognizer], keep_off: tuple[str, str] | None = None, window: int = CONTEXT_WINDOW
) -> str:
    """SQL for the spans of all recognizers, in no particular order.

    A context word raises a score if it stands in the ``window`` characters before or after a match.

    Only the regex calls are made per recognizer; offsets, scores and checks are worked out
    by one shared expression over those which found something. ``keep_off`` is a literal and
    a pattern of areas to leave alone; they come out as spans with an empty entity type.
    """
    rules = list(recognizers)
    families: dict[str, list[str]] = {}
    for number, rule in enumerate(rules):
        test = FAMILIES[rule.family].format(text=text)
        boosted = rule.score if rule.context_score is None else rule.context_score
        hit = _hit(text, rule.pattern, number, rule.entity_type, rule.score, rule.context, boosted)
        families.setdefault(test, []).append(hit)
    if keep_off is not None:
        literal, pattern = keep_off
        families[f"contains({text}, {quoted(literal)})"] = [_hit(text, pattern, -1, "", 1.0, None, 1.0)]
    if not families:
        return empty(SPAN)
    hits = ", ".join(
        f"if({test}, array({', '.join(members)}), {empty(_HIT)})" for test, members in families.items()
    )
    found = f"filter(concat({hits}), h -> size(h.found) > 0)"
    return f"flatten(transform({found}, h -> {_hit_spans('h', rules, window)}))"


_HIT = (
    "struct<rule:int,entity_type:string,score:double,context:string,context_score:double,"
    "found:array<string>,gaps:array<string>>"
)


def _hit(
    text: str, pattern: str, number: int, entity_type: str, score: float, context: str | None, boosted: float
) -> str:
    return let(
        "found",
        f"regexp_extract_all({text}, {quoted(pattern)}, 0)",
        f"CAST(struct({number}, {quoted(entity_type)}, {float(score)}D, {quoted(context)},"
        f" {float(boosted)}D, found, if(size(found) > 0, split({text}, {quoted(pattern)}, -1), NULL)) AS {_HIT})",
    )


def _hit_spans(hit: str, rules: list[Recognizer], window: int) -> str:
    # What stands around match i is put together from the gaps and the matches between them; a match
    # has at least one character, so ``window`` of them on either side are enough.
    low = f"greatest(i - {int(window)}, 0)"

    def side(cut: str, first: str, gaps: str, found: str) -> str:
        glued = f"(g, f) -> concat({cut}(g, {int(window)}), coalesce(f, ''))"
        parts = f"zip_with(slice({hit}.gaps, {first}, {gaps}), slice({hit}.found, {first}, {found}), {glued})"
        return f"{cut}(array_join({parts}, ''), {int(window)})"

    before = side("right", f"{low} + 1", f"i - {low} + 1", f"i - {low}")
    after = side("left", "i + 2", f"{int(window)} + 1", str(int(window)))

    def score(gap: str) -> str:
        near = f"({before} RLIKE {hit}.context OR {after} RLIKE {hit}.context)"
        return f"if({hit}.context IS NULL, {hit}.score, if({near}, {hit}.context_score, {hit}.score))"

    spans = located(f"{hit}.found", f"{hit}.gaps", f"{hit}.entity_type", score)
    checks = " ".join(
        f"WHEN {number} THEN {rule.check.format(match='s.text')}"
        for number, rule in enumerate(rules)
        if rule.check is not None
    )
    return f"filter({spans}, s -> CASE {hit}.rule {checks} ELSE true END)" if checks else spans
