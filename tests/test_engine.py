"""Rules, names, merging, masking and verification on small texts of our own."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.functions import validators as V
from veilspark.operators import docx, geometry, ledger, mask, shapes
from veilspark.operators.detect import detect
from veilspark.operators.rules import checked_labels
from veilspark.sources import documents
from veilspark.sources.tables import written

CASES = [
    ("주민번호 880101-1234567 입니다", [("RRN", "880101-1234567")]),
    ("９２０３１５-1234567", [("RRN", "９２０３１５-1234567")]),
    ("카드 4539 1488 0343 6467 결제", [("CARD", "4539 1488 0343 6467")]),
    ("국민은행 123456-78-901234 입금", [("ACCOUNT", "123456-78-901234")]),
    ("02)123-4567", [("PHONE", "02)123-4567")]),
    ("계약번호 1234-5678", []),
    ("81나3166 판결", [("CASE", "81나3166")]),
    ("차량 12가3456", [("CAR", "12가3456")]),
    ("법무법인(유한) 가나\n주        문", [("ORG", "법무법인(유한) 가나")]),
    ("피고 김철수는 말했다", [("NAME", "김철수")]),
    ("변호사 홍길동, 이영희, 박민수", [("NAME", "홍길동"), ("NAME", "이영희"), ("NAME", "박민수")]),
    ("배우자 명의로", []),
    ("원고에게", []),
    ("원고 이지은", [("NAME", "이지은")]),
    ("원고\n이지은", []),
    ("원고: 이지은", [("NAME", "이지은")]),
    ("참　　조서민수님", [("NAME", "서민수")]),
    ("x" * 3 + "1" * 50_000, []),
    (None, []),
    ("", []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return written(detect(docs), "found")


def test_detection(found):
    rows = {r.doc_id: [(f.label, f.value) for f in r.findings] for r in found.collect()}
    for i, (text, want) in enumerate(CASES):
        assert rows[i] == want, text and text[:80]


def test_name_chains_go_on_to_their_end(spark):
    names = [a + b + c for a in "김이박최정" for b in "민수영" for c in "철호준혁"]
    texts = ["원고 " + ", ".join(names) + "에게는", "원고 김철수, 이영희에게는", "원고 김철수, 선우정밀 산업에서", "피고 김철수, 박민수\n원고 이영희, 최준호", "원고 " + ", ".join(names[:30]) + ", 피고인, 정호준"]
    rows = {r.doc_id: r for r in mask.mask(written(detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "chains")).collect()}
    found = lambda i: [f.value for f in rows[i].findings]
    assert len(names) == 60 and found(0) == names and not any(n in rows[0].masked for n in names)
    assert found(1) == ["김철수", "이영희"] and found(2) == ["김철수"] and sorted(found(3)) == sorted(["김철수", "박민수", "이영희", "최준호"])
    assert found(4) == names[:30]


def test_queries_over_tables_look_for_every_label(spark, tmp_path):
    from veilspark.plans import catalogue

    held = {1: ("PHONE", "(017) 555-7713"), 2: ("PHONE", "0411590525"), 3: ("EMAIL", "a.b@example.com"), 4: ("NAME", "김철수"), 5: ("RRN", "880101-1234567")}
    texts = {0: "nothing", 1: "call (017) 555-7713 now", 2: "id 0411590525 end", 3: "to a.b@example.com", 4: "원고 김철수는", 5: "번호 880101-1234567", 6: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    rows.toDF("page_id", "html").write.parquet(f"{tmp_path}/pages.parquet")
    rows.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), "text").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    for name in ("detect_documents", "detect_pages"):
        assert {(r.doc_id, (r.label, r.value)) for r in run(name)} == set(held.items())
    assert {(r.label, r.n_values, r.n_docs) for r in run("findings_by_every_label")} == {("PHONE", 2, 2), ("EMAIL", 1, 1), ("NAME", 1, 1), ("RRN", 1, 1)}
    masked = {r.doc_id: r for r in run("mask_token_documents")} | {f"c{r.conv_id}": r for r in run("conversation_mask")}
    for i, (_, value) in held.items():
        assert value not in masked[i].masked and masked[i].n_replaced == 1 and value not in masked[f"c{i}"].masked
    assert all(r.restored == texts[r.doc_id] and r.n_unresolved == r.n_residual == 0 for r in run("restore_roundtrip"))


def test_emails_within_longer_ones_are_listed(spark, tmp_path):
    from veilspark.plans import catalogue

    rows = spark.createDataFrame([(1, "to ab.22@mail7.example or ab.22@mail7.example.com"), (2, "to cd@mail7.example, cd@mail7.example.com")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    rows.toDF("page_id", "html").write.parquet(f"{tmp_path}/pages.parquet")
    want = {(i, f"{name}@mail7.example{end}") for i, name in ((1, "ab.22"), (2, "cd")) for end in ("", ".com")}
    for name in ("detect_email_card_documents", "detect_email_card_pages"):
        assert {(r.doc_id, r.value) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} == want
    assert {(r.label, r.n_values, r.n_docs) for r in catalogue.findings_by_label(spark, str(tmp_path)).collect()} == {("EMAIL", 4, 2)}


def test_mask_and_restore(found):
    for r in mask.restore(mask.mask(found)).collect():
        assert r.restored == r.text and r.residual == [] and r.unresolved == []
        assert r.text is not None or r.masked is None


def test_anonymous_forms(found):
    rows = {r.doc_id: r.masked for r in mask.anonymise(found).collect()}
    assert rows[9] == "피고 김OO는 말했다" and rows[0] == "주민번호 ■■■■ 입니다"


def test_labels_that_cannot_be_skipped():
    with pytest.raises(ValueError, match="EMAIL"):
        checked_labels(["PERSON"])


def test_ledger_shares_aliases_and_goes_on(spark):
    f = spark.createDataFrame([(1, 0, "NAME", "김철수"), (1, 5, "NAME", "김 철수"), (2, 0, "ORG", "갑사"), (3, 0, "NAME", "박민수")], "doc_id long, pos int, label string, value string")
    first = written(ledger.extend(f), "ledger")
    assert {(r.kind, r.norm, r.alias) for r in first.collect()} == {("PERSON", "김철수", "A"), ("ORG", "갑사", "A사"), ("PERSON", "박민수", "B")}
    more = ledger.extend(spark.createDataFrame([(9, 0, "NAME", "이지은"), (9, 3, "NAME", "김철수")], f.schema), first)
    assert ("이지은", "C") in {(r.norm, r.alias) for r in more.collect()} and more.count() == 4


def test_ledger_takes_text_ids_and_issues_no_alias_twice(spark):
    read = documents.parsed_ledger(spark.createDataFrame([('{"PERSON": {"김철수": "A", "박민수": "D2", "최유리": "별명"}, "ORG": {"갑사": "AB사"}, "CASE": {"2020가합1": "사건C"}}',)], "value string"))
    assert {(r.kind, r.alias): r.ordinal for r in read.collect()} == {("PERSON", "A"): 0, ("PERSON", "D2"): 3, ("PERSON", "별명"): None, ("ORG", "AB사"): 27, ("CASE", "사건C"): 2}
    f = spark.createDataFrame([("x-1", 0, "NAME", "이지은"), ("x-2", 3, "NAME", "정호준"), ("x-2", 9, "ORG", "을사")], "doc_id string, pos int, label string, value string")
    assert {r.alias for r in ledger.entries_of(f, read).collect()} == {"E", "F", "AC사"}


def test_codes_of_all_longs(spark):
    numbers = [0, 25, 26, 701, 702, 321_272_405, 321_272_406, 2**62, 2**63 - 1]

    def code(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", X.code(F.col("n")).alias("c")).withColumn("back", X.ordinal_of(F.col("c"))).collect()
    assert [r.c for r in rows] == [code(n) for n in numbers] and all(r.back == r.n for r in rows if len(r.c) <= 13)


def test_positions_and_first_values_of_many_matches(spark):
    text = "".join(f"{'가' * (k % 3)}1{k % 7}" for k in range(2000))
    r = spark.createDataFrame([(text,)], "t string").select(X.spans(F.col("t"), "[0-9]+").alias("s"), X.first_of(X.spans(F.col("t"), "[0-9]+")).alias("f")).first()
    import re

    want = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert [(x.start, x.stop, x.value) for x in r.s] == want
    assert [x.value for x in r.f] == list(dict.fromkeys(v for _, _, v in want))


def test_users_columns_stay(spark):
    docs = spark.createDataFrame([(1, "원고 김철수는", "a", "b", "c")], "doc_id long, text string, _own string, _c1 string, masked string")
    found = detect(docs)
    row = mask.restore(mask.mask(found)).first()
    assert (row["_own"], row["_c1"], row.restored) == ("a", "b", "원고 김철수는") and mask.anonymise(found).first()["_own"] == "a"
    with pytest.raises(ValueError):
        detect(docs.withColumn("__veil_scan", F.lit(1)))


def test_aliases_are_restored(spark):
    docs = written(detect(spark.createDataFrame([(1, "원고 김철수는 A 안을 김 철 수 에게"), (2, "피고 박민수와 원고 김철수")], "doc_id long, text string")), "alias-docs")
    from veilspark.operators.detect import exploded

    known = ledger.extend(exploded(docs))
    for done in (mask.mask(mask.alias_marks(docs, known), marks_col="alias_marks"), mask.mask(mask.alias_marks(docs), marks_col="alias_marks")):
        rows = mask.restore(done).orderBy("doc_id").collect()
        assert rows[0].masked == "원고 A2는 A 안을 A2 에게" and rows[0].restored == "원고 김철수는 A 안을 김철수 에게" and rows[1].restored == rows[1].text
        assert all(r.residual == [] and r.collisions == [] for r in rows)


def test_suffixes_of_aliases(spark):
    import re
    import time

    def mark(text, alias):
        alone = lambda m: re.search(f"(?<![0-9A-Za-z가-힣]){re.escape(m)}(?![0-9A-Za-z])", text)
        return next(m for m in [alias, *(f"{alias}{k}" for k in range(2, 100))] if not alone(m))

    cases = [("A B", "C"), ("A, A2, A3", "A"), ("AA A22 A3", "A"), ("A A2x 갑A2 A02", "A"), ("A " + " ".join(f"A{k}" for k in range(2, 99)), "A"), ("K-K K-K2-K3 K-K4", "K-K"), ("K2-K K2-K2-K3", "K2-K"), ("전화A 전화A10 전화A2", "전화A"), ("D2 D22 D24", "D2"), ("A.", "A"), ("", "A")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, text string, alias string")
    got = {r.i: r.mark for r in rows.select("i", mask.alias_mark(F.col("text"), F.col("alias")).alias("mark")).collect()}
    assert got == {i: mark(*c) for i, c in enumerate(cases)}
    full = spark.createDataFrame([("A " + " ".join(f"A{k}" for k in range(2, 100)), "A")], "text string, alias string")
    with pytest.raises(Exception, match="no mark is free for A"):
        full.select(mask.alias_mark(F.col("text"), F.col("alias")).alias("mark")).collect()
    many = spark.range(0, 20_000, numPartitions=1).select(mask.alias_mark(F.concat(F.lit("원고 A 안을 "), F.col("id").cast("string")), F.lit("전화A")).alias("mark"))
    slow = max(1.0, min(_seconds(lambda: sum(range(1_000_000)), time.perf_counter) for _ in range(5)) / 0.02)
    assert _seconds(lambda: many.agg(F.countDistinct("mark")).collect(), time.perf_counter) < 2.5 * slow


def test_masked_queries_deal_out_keys(spark, tmp_path):
    from veilspark.plans import catalogue

    spark.range(300).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert catalogue.mask_alias_style(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_reports(spark):
    docs = detect(spark.createDataFrame([(1, "원고 김철수는 123-45-678 을"), (2, "없음")], "doc_id long, text string"))
    done = mask.anonymise(docs).withColumn("lost", F.when(F.col("doc_id") == 2, F.array(F.lit("x"))))
    rows = shapes.report(done, unmapped_col="lost", recogniser=True).orderBy("doc_id").collect()
    assert [(r.exit_code, r.unmapped, len(r.warnings), r.engine.recogniser) for r in rows] == [(2, [], 1, True), (1, ["x"], 0, True)] and rows[0].persons == ["김철수"]
    assert "rules alone" in shapes.report(done).first().warnings[-1]


def test_giant_documents_in_the_published_time(spark):
    import time

    detect(spark.createDataFrame([(0, "원고 김철수")], "doc_id long, text string")).collect()  # plans and compiles
    for text, seconds in (("1234567890" * 10_000, 3.0), ("가나다라마바사아자차" * 20_000, 5.0)):
        docs = written(spark.createDataFrame([(1, text)], "doc_id long, text string"), "giant")
        best = min(_seconds(lambda: detect(docs).select("findings").collect(), time.perf_counter) for _ in range(2))
        # The bound is for a machine that adds up a million numbers in 20 ms.
        slow = max(1.0, min(_seconds(lambda: sum(range(1_000_000)), time.perf_counter) for _ in range(5)) / 0.02)
        assert best < seconds * slow, (len(text), best, slow)


def _seconds(run, clock) -> float:
    began = clock()
    run()
    return clock() - began


def test_text_functions_and_validators(spark):
    r = spark.range(1).select(X.code(F.lit(0)).alias("a"), X.code(F.lit(25)).alias("z"), X.code(F.lit(26)).alias("aa"), X.code(F.lit(702)).alias("aaa"), X.agree(F.lit("은"), F.lit("나무")).alias("j"), X.peek(F.lit("01012345678")).alias("p"), V.business_number(F.lit("220-81-62517")).alias("b"), V.card_number(F.lit(None).cast("string")).alias("n")).first()
    assert tuple(r) == ("A", "Z", "AA", "AAA", "는", "01…○○○○○○○○8", True, False)


def test_exit_codes(spark):
    one, none = F.array(F.lit("x")), F.array().cast("array<string>")
    r = spark.range(1).select(shapes.exit_code(one, none, one), shapes.exit_code(none, none, one), shapes.exit_code(none, none, none)).first()
    assert tuple(r) == (1, 2, 0)


def test_dictionary_and_ledger_sources(spark):
    lines = spark.createDataFrame([(" 홍길동 ",), ("# note",), ("",), ("홍길동",)], "value string")
    assert [r.word for r in documents.words(lines).collect()] == ["홍길동"]
    old = spark.createDataFrame([('{"김철수": "A", "박민수": "B"}',), ('{"ORG": {"갑 사": "A사"}}',)], "value string")
    assert {(r.kind, r.norm, r.ordinal) for r in documents.parsed_ledger(old).collect()} == {("PERSON", "김철수", 0), ("PERSON", "박민수", 1), ("ORG", "갑사", 0)}


def _package() -> bytes:
    out = io.BytesIO()
    ns = f'xmlns:w="{docx.W}"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:r><w:t>원고 김</w:t></w:r><w:r><w:t>철수는</w:t></w:r></w:p><w:p><w:ins w:author="김철수"><w:r><w:delText>010-1234-5678</w:delText></w:r></w:ins></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="urn:d"><dc:creator>김철수</dc:creator></c>')
        z.writestr("docProps/thumbnail.jpeg", b"x")
    return out.getvalue()


def test_packages(spark):
    packages = spark.createDataFrame([(1, _package()), (2, b"not a zip"), (3, None)], "doc_id long, content binary")
    assert [r.text for r in docx.texts(docx.runs(packages)).collect()] == ["원고 김철수는\n010-1234-5678"]
    values = spark.createDataFrame([(1, "김철수", "김OO"), (1, "010-1234-5678", "■■■■"), (1, "없는값", "O")], "doc_id long, value string, repl string")
    done = docx.masked_packages(packages, values)
    (row,) = done.collect()
    assert row.unmapped == ["없는값"]
    assert docx.package_runs(bytes(row.content)) == [("word/document.xml", 0, 0, "원고 김OO"), ("word/document.xml", 0, 1, "는"), ("word/document.xml", 1, 0, "■■■■")]
    again = spark.createDataFrame([(1, bytes(row.content))], "doc_id long, content binary")
    assert docx.residual(docx.parts(again), values).count() == 0
    assert docx.risks(docx.parts(packages)).first().warnings == ["tracked changes", "thumbnail removed"]


def test_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([(1, 1, 0, 2.0, 2.0, 12.0, 8.0, "a"), (1, 1, 1, 9.0, 0.0, 30.0, 10.0, "b")], "doc_id long, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    assert tuple(geometry.expand(boxes, words).first())[3:] == (-1.0, -1.0, 13.0, 11.0)
