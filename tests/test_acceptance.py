"""Values that must be found, and words that must not be, each in a sentence of our own."""

import pytest

from veilspark.operators.detect import detect
from veilspark.sources.tables import written

FOUND = [
    ("그의 주민등록번호는 900215-2345678 로 적혀 있다", "900215-2345678"),
    ("등록된 번호 9002152345678 참고", "9002152345678"),
    ("주민번호 900215−2345678 기재", "900215−2345678"),
    ("번호 9 0 0 2 1 5 - 2 3 4 5 6 7 8 참고", "9 0 0 2 1 5 - 2 3 4 5 6 7 8"),
    ("결제 카드 4539-1488-0343-6467 사용", "4539-1488-0343-6467"),
    ("여권 S87654321 분실", "S87654321"),
    ("사업자번호 220-81-62517 업체", "220-81-62517"),
    ("면허 21-08-123456-70 취소", "21-08-123456-70"),
    ("연락은 010 - 2345 - 6789 로", "010 - 2345 - 6789"),
    ("사무실 (031)234-5678 대표", "(031)234-5678"),
    ("휴대폰 01023456789 로", "01023456789"),
    ("지사 0312345678 로", "0312345678"),
    ("콜센터 1577-1000 상담", "1577-1000"),
    ("신한은행 110-234-567890 으로 보냄", "110-234-567890"),
    ("입금은 우리 1002-345-678901 로", "1002-345-678901"),
    ("메일은 kim.lee@sample.or.kr 이다", "kim.lee@sample.or.kr"),
    ("화물차 85버1234 견인", "85버1234"),
    ("원고는 피고 정하나에게 갚으라", "정하나"),
    ("피고 박서준은 원고 최유리에게 준다", "박서준"),
    ("피고인 최유리 는 다투었다", "최유리"),
    ("최유리에게 돌려주라", "최유리"),
    ("피고소인은 한지민이다", "한지민"),
    ("송하윤(900215-2345678)은 남았다", "송하윤"),
    ("배우자 송하윤과 아들 박서준", "송하윤"),
    ("박서준씨는 그날", "박서준"),
    ("결재 최유리 과장 확인", "최유리"),
    ("소송대리인 변호사 정우진", "정우진"),
    ("변호사 정우진, 송하윤", "송하윤"),
    ("원고 박가은은 나왔다", "박가은"),
    ("성명: 정 우 진", "정 우 진".replace(" ", "")),
    ("박○○은 나왔다", "박○○"),
    ("채무자 최유리는 갚지 않았다", "최유리"),
    ("임차인 한지민이 받았다", "한지민"),
    ("피고 주식회사 누리물산 대표이사", "주식회사 누리물산"),
    ("대리인 법무법인(유한) 누리", "법무법인(유한) 누리"),
    ("위 2019나23456 판결", "2019나23456"),
    ("조심2018중2345 사건", "조심2018중2345"),
    ("주소: 강원도 춘천시 중앙로 1", "강원도 춘천시 중앙로 1"),
    ("사건번호가 2019나23456이며", "2019나23456"),
    ("법원 2018구단3456을 보면", "2018구단3456"),
    ("입금계좌 하나은행 4444-05-7654321", "4444-05-7654321"),
    ("원고 최유리는 주식회사 누리물산에 청구한다", "최유리"),
    ("주민등록번호 ９００２１５-２３４５６７８", "９００２１５-２３４５６７８"),
    ("연락처 ０１０-２３４５-６７８９", "０１０-２３４５-６７８９"),
]
LEFT = [
    ("주문번호 2345-6789 확인", "2345-6789"),
    ("찬성 7:2 로 통과", "7:2"),
    ("원심은 이와 같이 보았다", "원심"),
    ("정답을 적지 않았다", "정답"),
    ("이사회는 승인하지 않았다", "이사회"),
    ("한다는 말은 맞지 않다", "한다"),
    ("문항 수가 다르다", "문항"),
    ("조합원에게 나누어 주었다", "조합원"),
    ("배우자 명의로 산 집", "명의"),
    ("피고 패소 부분만 다툰다", "패소"),
    ("청구인 주장은 옳지 않다", "주장"),
    ("담당변호사 정우진 낭독", "담당"),
    ("김포시는 허가하였다", "김포"),
    ("피고 누리자 산신탁은", "누리자"),
    ("피고 경기도시\n공사는", "경기도시"),
    ("사내이사 해임의 건", "사내"),
    ("문서 2345678923456789 확인", "2345678923456789"),
    ("번호 309097-1234567 은 잘못", "309097-1234567"),
    ("원고\n이지은 나무", "이지은"),
    ("도지사에게 알렸다. 구청장에게도 고객들에게도 알렸다", "도지사"),
    ("피고 경비 부장", "경비"),
]


@pytest.fixture(scope="module")
def values(spark):
    docs = spark.createDataFrame(list(enumerate(t for t, _ in FOUND + LEFT)), "doc_id long, text string")
    return {r.doc_id: {f.value for f in r.findings} for r in written(detect(docs), "acceptance").collect()}


def test_values_are_found(values):
    assert {t: sorted(values[i]) for i, (t, v) in enumerate(FOUND) if v not in values[i]} == {}


def test_words_are_left(values):
    assert {t: sorted(values[i]) for i, (t, v) in enumerate(LEFT, len(FOUND)) if v in values[i]} == {}


def test_trade_names(spark):
    cases = [
        ("피고 주식회사 누리물산은 갚는다", ["주식회사 누리물산"]), ("매수인인 누리물산 주식회사와 맺었다", ["누리물산 주식회사"]), ("저희 주식회사는 작다", []),
        ("㈜누리 하나, 끝", ["㈜누리 하나"]), ("주식회사 누리물산(이하 '누리'라 한다)", ["주식회사 누리물산"]), ("누리 주식회사 물산", ["누리 주식회사"]), ("노무법인 가온. 끝", ["노무법인 가온"]),
    ]
    docs = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    rows = {r.doc_id: [f.value for f in r.findings if f.label == "ORG"] for r in detect(docs, skip=["NAME"]).collect()}
    assert {cases[i][0]: v for i, v in rows.items()} == dict(cases)


def test_users_words(spark):
    docs = spark.createDataFrame([(1, "특 별 고 객 명단", [("PERSON", "김철수")]), (2, "그날 김철수 왔다", [("PERSON", "김철수"), ("PERSON", "박민수")])], "doc_id long, text string, ner array<struct<label:string,value:string>>")
    rows = {r.doc_id: [f.value for f in r.findings] for r in detect(docs, extra_names=["특별고객"], excluded_names=["김철수"], ner_col="ner").collect()}
    assert rows == {1: ["특별고객"], 2: ["박민수"]}
