"""Patterns of composed values, put together from parts: words, numbers, separators and edges.

A part is a piece of a Java pattern; functions here only join parts, so each rule reads as the sequence it looks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from veilspark.functions import lexicon as X
from veilspark.functions.lexicon import any_of, hint

BLANKS = r"[ \t]*"
LETTER, LETTER_OR_DIGIT = "[가-힣A-Za-z]", "[가-힣A-Za-z0-9]"


def number(least: int, most: int | None = 0) -> str:
    """ASCII digits: exactly `least`, up to `most`, or any more (None)."""
    return f"[0-9]{{{least}}}" if most == 0 else f"[0-9]{{{least},{most or ''}}}"


def maybe(part: str) -> str:
    return f"(?:{part})?"


def not_before(part: str) -> str:
    return f"(?!{part})"


def not_after(part: str) -> str:
    return f"(?<!{part})"


def apart(*parts: str) -> str:
    """Parts in order, with or without blanks between them."""
    return BLANKS.join(parts)


def standing(body: str, after: str = LETTER_OR_DIGIT) -> str:
    """A body that no letter or digit touches on its left, and nothing of `after` on its right (a particle may, if that leaves out Hangul)."""
    return not_after(LETTER_OR_DIGIT) + body + not_before(after)


# --- case numbers ------------------------------------------------------------


def case_number(*parts: str) -> str:
    """Parts of a case number; a particle may follow it."""
    return standing(apart(*parts), "[0-9A-Za-z]")


_DASH = "[-–]"
#: Pattern, what a text must hold for it, and whether a word of litigation must be near (as a licence plate looks alike).
CASE_NUMBERS: list[tuple[str, str, bool]] = [
    (case_number(number(4), any_of(X.COURT_CODES), number(1, None)), r"[0-9]{4}[ \t]*[가-힣]", False),
    (case_number(number(2), any_of(X.SHORT_COURT_CODES), number(2, 6)), r"[0-9]{2}[ \t]*[가-힣]", True),
    (case_number(maybe("20") + number(2), any_of(X.PROSECUTION_CODES), number(1, None) + maybe("호")), hint(X.PROSECUTION_CODES), False),
    (case_number(maybe(any_of(X.LABOUR_REGIONS)), number(4), any_of(X.LABOUR_CODES), number(1, None)), hint(X.LABOUR_CODES), False),
    (case_number("조심", number(4), maybe("[가-힣]"), number(3, 5)), "조심", False),
    (case_number(any_of(X.APPEAL_BOARDS), number(4) + maybe(_DASH) + number(1, 6)), "행심", False),
    (case_number(any_of(X.DECISIONS), maybe("제"), number(4) + _DASH + number(1, 4) + maybe(_DASH + number(1, 4)), "호"), hint(X.DECISIONS), False),
]


# --- organisations -----------------------------------------------------------

_TOPIC, _AND = "은는이가을를", "과와"
#: What a trade name holds after its first character; a bracket that defines a short name ends it.
_WITHIN = not_before(r"\(이하") + r"[가-힣A-Za-z0-9·&().-]"


def _name_word(first: str, least: int, most: int) -> str:
    """A word of a trade name, as short as what follows allows; words that name a role aren't one."""
    role = any_of(X.ORG_ROLES) + f"(?:[{_TOPIC}{_AND}의도로에]|{not_before('[가-힣]')})"
    return f"{not_before(role)}{first}(?:{_WITHIN}){{{least},{most}}}?"


def organisation(forms: Sequence[str]) -> str:
    """A legal form with a trade name after it (up to two words) or before it (one word)."""
    form = any_of(list(forms))
    name_ends = rf"(?=[{_AND}{_TOPIC}]?(?:[\s,.;:()\[\]]|\z))"
    leading = apart(form, _name_word(LETTER_OR_DIGIT, 1, 29) + maybe(r"[ \t]" + _name_word(LETTER_OR_DIGIT, 0, 19))) + name_ends
    form_ends = rf"(?=[{_AND}{_TOPIC}의도로에]|[^가-힣A-Za-z0-9]|\z)"
    trailing = apart(_name_word(LETTER, 1, 29) + not_after(f"[{_AND}{_TOPIC}]"), form) + form_ends
    return not_after(LETTER_OR_DIGIT) + f"(?:{leading}|{trailing})"


# --- addresses ---------------------------------------------------------------

_ROOM = r"[가-힣0-9 \t,·.-]"


def labelled_address(labels: Sequence[str]) -> str:
    """What follows an address label (its syllables may be spaced) and a blank or colon, up to the end of the line; group 1."""
    label = any_of([r"\s*".join(w) for w in labels])
    return label + r"[\s:：]+" + r"([가-힣][^\n;]{4,70})"


def bracketed_detail(endings: str) -> str:
    """A bracket on one line that names a quarter, village or road; group 1."""
    return rf"(\({_ROOM}{{2,30}}[{endings}]{_ROOM}{{0,30}}\))"


def regional_address(regions: Sequence[str]) -> str:
    """A province or city, then words up to a number; group 1."""
    words = r"[가-힣0-9 \t\-·,()]{4,60}?"
    return f"({any_of(list(regions))}[ \\t]?{words}{number(1, None)}{maybe('-' + number(1, None))}{maybe('호|번지')})"
