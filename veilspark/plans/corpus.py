"""Synthetic Korean texts, built from the keys of whole tables, with the findings that each text must give.

Texts and expected values are SQL expressions that Spark and DuckDB read alike, so the oracle follows from how a text was built and not from
any pattern. In an expression, {k} is the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field


def num(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def idiv(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}.0) AS INT)"


def digit(k: str, place: int) -> str:
    return f"mod({idiv(k, 10**place)}, 10)"


K = "{k}"
NAME = "(substr('김이박최정한', CAST({k} % 6 AS INT) + 1, 1) || substr('민수영희철수서연하준', CAST({k} % 5 AS INT) * 2 + 1, 2))"
OTHER = "(substr('조윤임오강신', CAST({k} % 6 AS INT) + 1, 1) || substr('도윤예린태민수아지훈', CAST({k} % 5 AS INT) * 2 + 1, 2))"
TRADE = "(substr('한빛가온누리해솔', CAST({k} % 4 AS INT) * 2 + 1, 2) || substr('전자화학물산테크', CAST({k} % 4 AS INT) * 2 + 1, 2))"
RRN = f"('8' || CAST({K} % 10 AS STRING) || {num(f'{K} % 12 + 1', 2)} || {num(f'{K} % 28 + 1', 2)} || '-1' || {num(f'{K} % 1000000', 6)})"
LATE = f"('8' || CAST({K} % 10 AS STRING) || '19' || {num(f'{K} % 28 + 1', 2)} || '-1' || {num(f'{K} % 1000000', 6)})"
_A, _B, _C = digit(K, 0), digit(K, 1), digit(K, 2)
# 1 2 a | 8 b | c 3 4 5: weights 1 3 7 1 3 7 1 3 5.
BIZ_CHECK = f"mod(10 - mod(57 + 7 * {_A} + 3 * {_B} + 7 * {_C}, 10), 10)"
BIZ = f"('12' || CAST({_A} AS STRING) || '-8' || CAST({_B} AS STRING) || '-' || CAST({_C} AS STRING) || '345' || CAST({BIZ_CHECK} AS STRING))"
BIZ_BAD = BIZ.replace(f"CAST({BIZ_CHECK} AS STRING)", f"CAST(mod({BIZ_CHECK} + 1, 10) AS STRING)")


def _twice(d: str) -> str:
    return f"2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END"


# 4539 1488 0343 abcX: from the right, X counts once, c twice, b once, a twice and so on.
_FIXED = sum((lambda n: n - 9 if n > 9 else n)(int(c) * (2 if i % 2 == 0 else 1)) for i, c in enumerate("453914880343"))
CARD_CHECK = f"mod(10 - mod({_FIXED} + {_twice(_A)} + {_B} + {_twice(_C)}, 10), 10)"
_TAIL = f"(CAST({_A} AS STRING) || CAST({_B} AS STRING) || CAST({_C} AS STRING) || CAST({CARD_CHECK} AS STRING))"
CARD, CARD_SPACED, CARD_PLAIN = f"('4539-1488-0343-' || {_TAIL})", f"('4539 1488 0343 ' || {_TAIL})", f"('453914880343' || {_TAIL})"
CARD_BAD = f"('4539-1488-0343-' || CAST({_A} AS STRING) || CAST({_B} AS STRING) || CAST({_C} AS STRING) || CAST(mod({CARD_CHECK} + 1, 10) AS STRING))"
WIDE = lambda e: f"translate({e}, '0123456789', '０１２３４５６７８９')"
FOUR, SIX, SEVEN = num(f"{K} % 9000 + 1000", 4), num(f"{K} % 900000 + 100000", 6), num(f"{K} % 9000000 + 1000000", 7)


def flat(sql: str) -> str:
    """SQL whose grouped concatenations `(a || b)` are calls of concat(): Spark's parser needs exponential time for nested groups."""

    def group(i: int) -> tuple[str, int, bool]:
        out, joined = "", False
        while i < len(sql):
            if sql[i] == "'":
                end = sql.index("'", i + 1) + 1
                out, i = out + sql[i:end], end
            elif sql[i] == "(":
                inner, end, concat = group(i + 1)
                call = out[-1:].isalnum() or out[-1:] == "_"
                out, i = out + ("concat" if concat and not call else "") + f"({inner})", end
            elif sql[i] == ")":
                return out, i + 1, joined
            elif sql.startswith(" || ", i):
                out, i, joined = out + ", ", i + 4, True
            else:
                out, i = out + sql[i], i + 1
        return out, i, joined

    return group(0)[0]


@dataclass(frozen=True)
class Case:
    """A query: variants by key modulo their number, each a text and the (label, value) pairs that it must give."""

    variants: Sequence[tuple[str, Sequence[tuple[str, str]]]]
    table: str = "customer"
    key: str = "c_custkey"
    skip: Sequence[str] = ("NAME",)
    extra_names: Sequence[str] = ()
    excluded_names: Sequence[str] = field(default=())

    def text(self) -> str:
        n = len(self.variants)
        arms = " ".join(f"WHEN {{k}} % {n} = {i} THEN {text}" for i, (text, _) in enumerate(self.variants))
        return flat(f"CASE {arms} END").replace("{k}", self.key)

    def oracle(self) -> str:
        n, parts = len(self.variants), []
        for i, (_, found) in enumerate(self.variants):
            for label, value in found:
                parts.append(f"SELECT {self.key} AS doc_id, '{label}' AS label, {value} AS value FROM {self.table} WHERE {self.key} % {n} = {i}".replace("{k}", self.key))
        return " UNION ALL ".join(parts)


def said(before: str, value: str, after: str = "") -> str:
    return f"('{before}' || {value} || '{after}')"


PHONE, AREA, REP = f"('010-' || {FOUR} || '-' || {FOUR})", f"('02) ' || {FOUR} || '-' || {FOUR})", f"('1588-' || {FOUR})"
BANK, PASS, DRIVER, CORP = f"({SIX} || '-' || {num(f'{K} % 90 + 10', 2)} || '-' || {SIX})", f"('M' || {num(f'{K} % 90000000 + 10000000', 8)})", f"('11-' || {num(f'{K} % 90 + 10', 2)} || '-' || {SIX} || '-' || {num(f'{K} % 90 + 10', 2)})", f"({num(f'{K} % 9 + 1', 1)} || '10111-9' || {num(f'{K} % 1000000', 6)})"
TWO, THREE = num(f"{K} % 90 + 10", 2), num(f"{K} % 900 + 100", 3)
MAIL = f"('user' || CAST({K} AS STRING) || '@example.co.kr')"
ROAD = f"('서울특별시 송파구 올림픽로 ' || CAST({K} % 900 + 1 AS STRING))"

#: More names than any list in a row needs, each of its own.
LONG_CHAIN = [a + b for a in "김박최정강한" for b in ("민철", "수호", "영준", "예린")]

CASES: dict[str, Case] = {
    "detect_rrn": Case([(said("주민등록번호 ", RRN, " 확인"), [("RRN", RRN)]), (said("번호는 ", WIDE(RRN), "이다"), [("RRN", WIDE(RRN))]), (said("문서번호 ", LATE, " 참조"), [])]),
    "detect_card": Case([(said("카드 ", CARD, " 결제"), [("CARD", CARD)]), (said("카드 ", CARD_SPACED), [("CARD", CARD_SPACED)]), (said("카드", CARD_PLAIN, "로"), [("CARD", CARD_PLAIN)]), (said("문서 ", CARD_BAD, " 참조"), [])]),
    "detect_bizno": Case([(said("사업자등록번호 ", BIZ, "호"), [("BIZNO", BIZ)]), (said("관리번호 ", BIZ_BAD), [])]),
    "detect_passport": Case([(said("여권 ", PASS), [("PASSPORT", PASS)]), (said("여권 AB", SEVEN, "이며"), [("PASSPORT", f"('AB' || {SEVEN})")]), (said("코드 XM", num(f"{K} % 90000000 + 10000000", 8)), [])]),
    "detect_driver": Case([(said("면허 ", DRIVER, " 소지"), [("DRIVER", DRIVER)]), (said("면허 1", DRIVER), [])]),
    "detect_corpno_context": Case([(said("법인등록번호 ", CORP, " 회사"), [("CORPNO", CORP)]), (said("관리번호 ", CORP, " 물품"), [])]),
    "detect_account_context": Case([(said("국민은행 ", BANK, " 앞"), [("ACCOUNT", BANK)]), (said("물품번호 ", BANK, " 출고"), []), ("'입금 계좌 1111111111'", [])]),
    "detect_phone_variants": Case([(said("전화 ", PHONE), [("PHONE", PHONE)]), (said("사무실 ", AREA, "로"), [("PHONE", AREA)]), (said("상담 ", REP, " 문의"), [("PHONE", REP)]), (said("계약번호 ", f"('2' || {THREE} || '-' || {FOUR})"), []), (said("계약번호 ", f"('16' || {TWO} || '-' || {FOUR})"), [("PHONE", f"('16' || {TWO} || '-' || {FOUR})")]), (said("연락 010", f"({FOUR} || {FOUR})"), [("PHONE", f"('010' || {FOUR} || {FOUR})")])]),
    "detect_email_forms": Case([(said("메일 ", MAIL, "로"), [("EMAIL", MAIL)]), (said("메일 user", f"CAST({K} AS STRING)", " @ example.com 앞"), [("EMAIL", f"('user' || CAST({K} AS STRING) || ' @ example.com')")]), (said("주소가 user", f"CAST({K} AS STRING)", "@host 이다"), [])]),
    "detect_case_numbers": Case([(said("사건 2020가합", FOUR, "이며"), [("CASE", f"('2020가합' || {FOUR})")]), (said("서울 2019부해", FOUR, " 판정"), [("CASE", f"('서울 2019부해' || {FOUR})")]), (said("조심2019서", FOUR, " 결정"), [("CASE", f"('조심2019서' || {FOUR})")]), (said("중앙행심 2020-", FOUR, " 재결"), [("CASE", f"('중앙행심 2020-' || {FOUR})")]), (said("2019형제", FOUR, "호에서"), [("CASE", f"('2019형제' || {FOUR} || '호')")]), (said("의결 제2020-", num(f"{K} % 900 + 100", 3), "호"), [("CASE", f"('의결 제2020-' || {num(f'{K} % 900 + 100', 3)} || '호')")])]),
    "detect_plate_or_case": Case([(said("차량 81나", FOUR, " 주차"), [("CAR", f"('81나' || {FOUR})")]), (said("판결 81나", FOUR, " 참고"), [("CASE", f"('81나' || {FOUR})")]), (said("차량 12가 ", FOUR), [("CAR", f"('12가 ' || {FOUR})")])]),
    "detect_org": Case([(said("피고 주식회사 ", TRADE, "은 갚는다"), [("ORG", f"('주식회사 ' || {TRADE})")]), (said("매수인인 ", TRADE, " 주식회사와 계약"), [("ORG", f"({TRADE} || ' 주식회사')")]), (said("법무법인 ", TRADE, ". 끝"), [("ORG", f"('법무법인 ' || {TRADE})")]), (said("문서 ", f"CAST({K} AS STRING)", " 저희 주식회사는"), [])], table="supplier", key="s_suppkey"),
    "detect_address": Case([(said("주소: ", ROAD), [("ADDRESS", ROAD)]), (said("건물은 ", ROAD, "번지 앞"), [("ADDRESS", f"({ROAD} || '번지')")]), (said("위치 (미성동, ", f"CAST({K} AS STRING)", "동 앞)"), [("ADDR_DETAIL", f"('(미성동, ' || CAST({K} AS STRING) || '동 앞)')")]), (said("소재지는 ", f"CAST({K} AS STRING)", " 곳"), [])]),
    "detect_names_prefix": Case([(said("피고 ", NAME, "는 말했다"), [("NAME", NAME)]), (said("소송대리인 변호사 ", NAME), [("NAME", NAME)]), (said("배우자 ", NAME, ", 끝"), [("NAME", NAME)]), ("'배우자 명의로 한다'", []), (said("참    조", NAME, " 앞"), [("NAME", NAME)]), ("'원고 정보를 본다'", [])], skip=()),
    "detect_names_suffix": Case([(said("그날 ", NAME, " 변호사가"), [("NAME", NAME)]), (said("그날 ", NAME, " 부장은"), [("NAME", NAME)]), (said("그날 ", NAME, "씨는"), [("NAME", NAME)]), (said("그날 ", NAME, "에게 갔다"), [("NAME", NAME)]), (said("피고소인은 ", NAME, "이다"), [("NAME", NAME)]), ("'담당 김○○ 확인'", [("NAME", "'김○○'")]), (said("그날 ", NAME, "(주민번호 확인)"), [("NAME", NAME)])], skip=()),
    "detect_name_chain": Case([(said("원고 ", NAME, ", ").replace("', ')", f"', ' || {OTHER} || ' 귀하')"), [("NAME", NAME), ("NAME", OTHER)]), (said("원고 ", NAME, ", 정보, 끝"), [("NAME", NAME)])], skip=()),
    "detect_name_negatives": Case([("'조합원에게 배당하였고 도지사에게 알렸다'", []), ("'청구인 주장은 피고 경비 부장과 다르다'", []), (said("원고\n", NAME, " 앞"), []), ("'배우자 명의로 산 김포시는 이사회에게'", []), (said("고객들에게 원고 ", NAME, "을 알렸다"), [("NAME", NAME)])], skip=()),
    "detect_name_long_chain": Case([("'원고 " + ", ".join(LONG_CHAIN) + "에게는'", [("NAME", f"'{n}'") for n in LONG_CHAIN])], table="supplier", key="s_suppkey", skip=()),
    "detect_standalone": Case([(said("원고 ", NAME, " 산업은행 앞"), []), (said("원고 ", NAME, " 앞"), [("NAME", NAME)])], skip=("CASE",)),
    "detect_containment": Case([(said("사건 2020가합", FOUR, "-") .replace("'-')", f"' 및 2020가합' || {FOUR} || '55 참조')"), [("CASE", f"('2020가합' || {FOUR} || '55')")]), (said("사건 2020가합", FOUR, " 참조"), [("CASE", f"('2020가합' || {FOUR})")])]),
    "label_skip": Case([(said("전화 ", PHONE, " 메일 ").replace("' 메일 ')", f"' 메일 ' || {MAIL})"), [("EMAIL", MAIL)])], skip=("NAME", "PHONE")),
    "user_dictionary": Case([(said("안건 ", f"CAST({K} AS STRING)", "호 특별고객 검토"), [("NAME", "'특별고객'")]), ("'피고 김민수는 왔다'", [])], skip=(), extra_names=("특별고객",), excluded_names=("김민수",)),
}


def joined(parts: Sequence[str]) -> str:
    return f"({' || '.join(parts)})"


@dataclass(frozen=True)
class Masked:
    """A query over masked texts: variants by key, each a sequence of (SQL expression, what stands for it in the masked text; None for what stays)."""

    variants: Sequence[Sequence[tuple[str, str | None]]]
    table: str = "customer"
    key: str = "c_custkey"

    def _by_key(self, of_variant) -> str:
        n = len(self.variants)
        return flat("CASE " + " ".join(f"WHEN {{k}} % {n} = {i} THEN {of_variant(v)}" for i, v in enumerate(self.variants)) + " END").replace("{k}", self.key)

    def text(self) -> str:
        return self._by_key(lambda v: joined([e for e, _ in v]))

    def masked(self) -> str:
        return self._by_key(lambda v: joined([e if m is None else m for e, m in v]))

    def replaced(self) -> str:
        return self._by_key(lambda v: str(sum(m is not None for _, m in v)))


_INITIAL = f"(substr({NAME}, 1, 1) || 'OO')"
_COURT, _COMPANY, _DETAIL = f"('2020가합' || {FOUR})", f"('주식회사 ' || {TRADE})", f"('(미성동, ' || CAST({K} AS STRING) || '동 앞)')"
_PLATE, _ROAD_MASK = f"('81나' || {FOUR})", f"('서울특별시 OOO OOOO ' || repeat('O', CAST(length(CAST({K} % 900 + 1 AS STRING)) AS INT)))"
#: Values of every label, as they stand in a text.
_EVERY = [
    [("'주민번호 '", RRN, "RRN"), ("' 카드 '", CARD, "CARD"), ("' 여권 '", PASS, "PASSPORT"), ("' 메일 '", MAIL, "EMAIL")],
    [("'사업자 '", BIZ, "BIZNO"), ("' 법인등록번호 '", CORP, "CORPNO"), ("' 면허 '", DRIVER, "DRIVER")],
    [("'국민은행 계좌 '", BANK, "ACCOUNT"), ("' 전화 '", PHONE, "PHONE"), ("' 또는 '", REP, "PHONE"), ("' 차량 '", f"('12가' || {FOUR})", "CAR")],
    [("'사건 '", _COURT, "CASE"), ("' 원고 '", NAME, "NAME"), ("' 피고 '", _COMPANY, "ORG")],
    [("'건물 '", f"({ROAD} || '번지')", "ADDRESS"), ("' 앞 '", _DETAIL, "ADDR_DETAIL")],
]


def _token_variant(values: list[tuple[str, str, str]]) -> list[tuple[str, str | None]]:
    """Marks count by kind; of the two telephone numbers, the longer comes first here."""
    out, seen = [], {}
    for before, value, label in values:
        kind = "PERSON" if label == "NAME" else label
        seen[kind] = seen.get(kind, 0) + 1
        out += [(before, None), (value, f"'[[{kind}_{seen[kind]:02d}]]'")]
    return [*out, ("', 끝'", None)]


def _anonymous_variant(values: list[tuple[str, str, str]]) -> list[tuple[str, str | None]]:
    forms = {"NAME": _INITIAL, "ORG": "'A사'", "CASE": "'사건A'", "ADDRESS": f"({_ROAD_MASK} || 'OO')", "ADDR_DETAIL": "'(OOO)'"}
    out = []
    for before, value, label in values:
        out += [(before, None), (value, forms.get(label, "'■■■■'"))]
    return [*out, ("', 끝'", None)]


MASKED_TOKENS, MASKED_ANON = Masked([_token_variant(v) for v in _EVERY]), Masked([_anonymous_variant(v) for v in _EVERY])
#: The text holds the alias A already in every other row.
MASKED_ALIASES = Masked([[("'원고 '", None), (NAME, "'A2'"), ("'에게 A 안을, 전화 '", None), (PHONE, "'전화A'"), ("' 로'", None)], [("'원고 '", None), (NAME, "'A'"), ("'에게 갑 안을, 전화 '", None), (PHONE, "'전화A'"), ("' 로'", None)]])
