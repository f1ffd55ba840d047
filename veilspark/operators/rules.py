"""Pattern rules: each is data, compiled into one native column expression over the digit-folded text.

A rule's matches go from left to right without overlap; a match that its context or check rejects has used up its characters. So
context and checks are filters after matching, not parts of the pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import lexicon as X
from veilspark.functions import validators as V
from veilspark.functions.lexicon import any_of, hint
from veilspark.functions.text import spans_of, strip, window
from veilspark.operators.grammar import BLANKS, CASE_NUMBERS, apart, bracketed_detail, labelled_address, not_before, number, organisation, regional_address, standing

LABELS = ["RRN", "CARD", "PASSPORT", "BIZNO", "CORPNO", "DRIVER", "ACCOUNT", "PHONE", "EMAIL", "CASE", "CAR", "ORG", "ADDRESS", "ADDR_DETAIL", "NAME", "PERSON"]
SKIPPABLE = [x for x in LABELS if x != "PERSON"]
DISPLAY = {"NAME": "이름", "PERSON": "이름", "RRN": "주민등록번호", "CARD": "카드번호", "PASSPORT": "여권번호", "BIZNO": "사업자등록번호", "CORPNO": "법인등록번호", "DRIVER": "운전면허번호", "ACCOUNT": "계좌번호", "PHONE": "전화번호", "EMAIL": "이메일", "CASE": "사건번호", "CAR": "차량번호", "ORG": "법인명", "ADDRESS": "주소", "ADDR_DETAIL": "상세주소"}
FINDINGS = "array<struct<rule_no:int,pos:int,label:string,value:string>>"
#: Characters on each side of a match in which a context word is looked for.
REACH = 40


@dataclass(frozen=True)
class Rule:
    """no: order of declaration (the first label of a value wins); group: of the pattern, that holds the value; needs: a cheap pattern without which the rule can't match; hangul: whether it (or its context) needs Hangul, else it needs a digit or an @."""

    no: int
    label: str
    pattern: str
    needs: str
    group: int = 0
    context: tuple[str, ...] = ()
    check: Callable[[Column], Column] | None = None

    @property
    def hangul(self) -> bool:
        return bool(self.context) or self.label in ("CASE", "CAR", "ORG", "ADDRESS", "ADDR_DETAIL")


_D, _S, _N = "[-−–—―.·]", BLANKS, "[0-9]"
_JOIN = apart("", _D, "")
_SEP, _MUST = f"{_S}{_D}?{_S}", rf"(?:{_JOIN}|[ \t]+)"
_NO_DIGIT_BEFORE, _NO_DIGIT_AFTER = "(?<![0-9])", "(?![0-9])"


def _apart(n: int, first: str = _N) -> str:
    """n digits that may be spaced."""
    return apart(first, *[_N] * (n - 1))


def _alone(body: str) -> str:
    return f"{_NO_DIGIT_BEFORE}(?:{body}){_NO_DIGIT_AFTER}"


_ACCOUNT_EDGE = "[0-9\\-−–—―]"
_TWO_SYLLABLE_CODES = [c for c in X.SHORT_COURT_CODES if len(c) == 2]


def _rules() -> list[Rule]:
    plain: list[tuple] = [
        ("RRN", _alone(f"{_apart(6)}{_JOIN}{_apart(7, '[1-8]')}|[0-9]{{6}}[1-8][0-9]{{6}}"), "[0-9]", 0, (), V.resident_number),
        ("CARD", _alone(f"[0-9]{{4}}(?:{_SEP}[0-9]{{4}}){{3}}|[0-9]{{16}}"), "[0-9]{4}", 0, (), V.card_number),
        ("PASSPORT", "(?<![A-Za-z0-9])(?:[MSRODmsrod][0-9]{8}|[A-Za-z]{2}[0-9]{7})(?![A-Za-z0-9])", "[A-Za-z][0-9]{7}", 0, (), None),
        ("BIZNO", _alone(f"[0-9]{{3}}{_JOIN}[0-9]{{2}}{_JOIN}[0-9]{{5}}"), "[0-9]{5}", 0, (), V.business_number),
        ("CORPNO", _alone(f"[0-9]{{6}}{_JOIN}[0-9]{{7}}"), "[0-9]{7}", 0, tuple(X.REGISTRY_CONTEXT), None),
        ("DRIVER", _alone(_JOIN.join(f"[0-9]{{{n}}}" for n in (2, 2, 6, 2))), "[0-9]{6}", 0, (), None),
        ("ACCOUNT", f"(?<!{_ACCOUNT_EDGE})[0-9]{{2,7}}(?:{_JOIN}[0-9]{{2,7}}){{1,3}}(?!{_ACCOUNT_EDGE})|{_alone('[0-9]{10,16}')}", "[0-9]{2}[^0-9]*[0-9]{2}", 0, tuple(X.ACCOUNT_CONTEXT), V.account_number),
        ("PHONE", f"(?<![0-9)])\\(?{V.PHONE_PREFIX}\\)?{_SEP}[0-9]{{3,4}}{_SEP}[0-9]{{4}}{_NO_DIGIT_AFTER}", "0[0-9]", 0, (), None),
        ("PHONE", _alone(f"{V.PHONE_PREFIX}[0-9]{{7,8}}"), "0[0-9]{8}", 0, (), None),
        ("PHONE", _alone(f"1[568][0-9]{{2}}{_MUST}[0-9]{{4}}"), "1[568][0-9]{2}", 0, (), None),
        ("EMAIL", r"[A-Za-z0-9._%+-]{1,64}\s*@\s*[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,}", "@", 0, (), None),
        *(("CASE", pattern, needs, 0, tuple(X.CASE_CONTEXT) if near else (), None) for pattern, needs, near in CASE_NUMBERS),
        ("CAR", standing(apart(number(2, 3) + not_before(any_of(_TWO_SYLLABLE_CODES)) + f"[{X.PLATE_SYLLABLES}]", number(4))), "[0-9][가-힣]", 0, (), None),
        ("ORG", organisation(X.COMPANY_FORMS), "회사|법인|주\\)|㈜", 0, (), None),
        ("ORG", organisation(X.FIRM_FORMS), "법인|사무소", 0, (), None),
        ("ADDRESS", labelled_address(X.ADDRESS_LABELS), hint(X.ADDRESS_LABELS), 1, (), None),
        ("ADDR_DETAIL", bracketed_detail("동가리로길"), "\\(", 1, (), None),
        ("ADDRESS", regional_address(X.REGIONS), hint(X.REGIONS), 1, (), None),
    ]
    return [Rule(k, label, pattern, needs, group, context, check) for k, (label, pattern, needs, group, context, check) in enumerate(plain, 1)]


RULES = _rules()


def rule_findings(rule: Rule, cut: Column, scan: Column, text: Column) -> Column:
    """A rule's findings, from its cuts of `scan`, the digit-folded text of the same length. Values are cut from the text itself."""
    found = spans_of(cut, rule.group)
    if rule.context:
        words = any_of(list(rule.context))
        found = F.filter(found, lambda m: window(scan, m["start"], m["stop"], REACH).rlike(words))
    # A group's value ends its match.
    at = (lambda m: m["start"]) if rule.group == 0 else (lambda m: m["stop"] - F.length(m["value"]))
    made = F.transform(found, lambda m: F.struct(F.lit(rule.no).alias("rule_no"), at(m).cast("int").alias("pos"), F.lit(rule.label).alias("label"), strip(F.substr(text, at(m) + 1, F.length(m["value"]))).alias("value")))
    keep = F.filter(made, lambda f: (F.length(f["value"]) >= 2) & (rule.check(f["value"]) if rule.check else F.lit(True)))
    return F.when(cut.isNull(), F.array().cast(FINDINGS)).otherwise(keep)


def checked_labels(skip: list[str] | tuple[str, ...]) -> set[str]:
    """Raises ValueError for a label that can't be skipped, naming those that can."""
    if unknown := set(skip) - set(SKIPPABLE):
        raise ValueError(f"can't skip {sorted(unknown)}; labels that can be skipped: {', '.join(SKIPPABLE)}")
    return set(skip)


def catalogue() -> list[tuple[int, str, str, str]]:
    """Rule number, label, pattern and context words of every rule."""
    return [(r.no, r.label, r.pattern, ",".join(r.context)) for r in RULES]
