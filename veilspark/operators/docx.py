"""Word-processor packages: text runs as rows, masking that keeps runs, scrubbing, and verification.

A package is a zip of XML parts. Scanning and rewriting a package is one Python call on its bytes (a package bounds the work); runs,
paragraphs, redistribution and residual checks are DataFrame operations.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The package's vocabulary.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TEXT_PARTS = re.compile(r"^word/(?:document|header|footer|footnotes|endnotes|comments|commentsExtended)[0-9]*\.xml$")
TEXT_NODES = ("t", "delText", "instrText")
META_TAGS = ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category", "contentStatus", "Company", "Manager", "HyperlinkBase", "Template", "Application")
AUTHOR_ATTRIBUTES, AUTHOR = ("author", "initials", "userId"), "작성자"
THUMBNAIL = re.compile(r"^docProps/thumbnail\.")
SUPPORTED = {".docx", ".pdf"}
ADVICE = {".doc": "save it as docx", ".hwp": "export it as pdf", ".hwpx": "export it as pdf", ".xls": "print it to pdf", ".xlsx": "print it to pdf", ".ppt": "export it as pdf", ".pptx": "export it as pdf", ".msg": "print it to pdf", ".eml": "print it to pdf"}


def supported(path: Column) -> Column:
    """Null for a supported format; else what to do."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    advice = F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv))
    return F.when(~ext.isin(*SUPPORTED, ".txt", ".md"), F.coalesce(F.try_element_at(advice, ext), F.lit("this format isn't supported")))


def output_name(path: Column, mode: str) -> Column:
    """The name of the masked file beside its source: _masked or _aliased, with the same ending."""
    return F.regexp_replace(path, r"(\.[^./\\]+)$", ("_masked" if mode == "anon" else "_aliased") + "$1")


def is_package(content: bytes | None) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return "word/document.xml" in z.namelist()
    except zipfile.BadZipFile:
        return False


def _walk(root: ElementTree.Element) -> Iterator[tuple[int, ElementTree.Element]]:
    """Text nodes with the number of their nearest paragraph (-1: none), in document order."""
    count = [-1]

    def visit(node: ElementTree.Element, paragraph: int) -> Iterator[tuple[int, ElementTree.Element]]:
        if node.tag == f"{{{W}}}p":
            count[0] += 1
            paragraph = count[0]
        if node.tag in {f"{{{W}}}{t}" for t in TEXT_NODES}:
            yield paragraph, node
        for child in node:
            yield from visit(child, paragraph)

    yield from visit(root, -1)


def package_runs(content: bytes) -> list[tuple[str, int, int, str]]:
    """(part, paragraph, run, text) of all text nodes, parts in order of name."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if TEXT_PARTS.match(n)):
            runs: dict[int, int] = {}
            for paragraph, node in _walk(ElementTree.fromstring(z.read(name))):
                runs[paragraph] = runs.get(paragraph, -1) + 1
                out.append((name, paragraph, runs[paragraph], node.text or ""))
    return out


def runs(packages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, part, para_no, run_no, text of packages (id_col, content); rows that aren't packages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                if is_package(content):
                    yield pd.DataFrame([(key, *r) for r in package_runs(content)], columns=["doc_id", "part", "para_no", "run_no", "text"])

    kind = packages.schema[id_col].dataType.simpleString()
    return packages.select(id_col, "content").mapInPandas(run, f"doc_id {kind}, part string, para_no int, run_no int, text string")


def paragraphs(rows: DataFrame) -> DataFrame:
    """Paragraphs of runs that aren't blank."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda r: r["text"]), "")
    return rows.groupBy("doc_id", "part", "para_no").agg(text.alias("text")).filter(F.trim("text") != "")


def texts(rows: DataFrame) -> DataFrame:
    """doc_id and text: paragraphs in order, one on each line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "para_no", "text"))), lambda p: p["text"])
    return paragraphs(rows).groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))


def redistribute(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs with replaced text. spans: doc_id, part, para_no, start, stop, repl, which don't overlap. A replacement goes into the run where its span begins; what it covers in later runs goes."""
    order = Window.partitionBy("doc_id", "part", "para_no").orderBy("run_no")
    own = rows.withColumn("r1", F.sum(F.length("text")).over(order).cast("int")).withColumn("r0", F.col("r1") - F.length("text"))
    key = ["doc_id", "part", "para_no"]
    lists = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "repl"))).alias("spans"))
    joined = own.join(lists, key, "left")
    touching = F.filter(F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int,repl:string>>")), lambda s: (s["start"] < F.col("r1")) & (s["stop"] > F.col("r0")))
    start = F.struct(F.lit("").alias("out"), F.col("r0").alias("at"))

    def place(acc: Column, s: Column) -> Column:
        before = F.substr(F.col("text"), acc["at"] - F.col("r0") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        repl = F.when(s["start"] >= F.col("r0"), s["repl"]).otherwise("")
        return F.struct(F.concat(acc["out"], before, repl).alias("out"), F.least(s["stop"], F.col("r1")).alias("at"))

    done = F.aggregate(touching, start, place, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] - F.col("r0") + 1, F.col("r1") - a["at"])))
    return joined.select(*key, "run_no", done.alias("text"))


def mask_package(content: bytes, values: list[tuple[str, str]]) -> tuple[bytes, list[str]]:
    """The package with values replaced and identities scrubbed, and the values that weren't met. values: (value, replacement).

    A value that occurs as it is is searched so, longest first; one of three characters or more also with blanks between its characters.
    """
    squashed = {re.sub(r"\s", "", v): r for v, r in reversed(values)}
    exact, met = dict(values), set()
    ordered = sorted(exact, key=len, reverse=True)
    spaced = [r"[ \t]*".join(map(re.escape, re.sub(r"\s", "", v))) for v in ordered if len(re.sub(r"\s", "", v)) >= 3]
    pattern = re.compile("|".join([*map(re.escape, ordered), *spaced])) if ordered else None

    def stand(m: re.Match) -> str:
        found = m[0] if m[0] in exact else re.sub(r"\s", "", m[0])
        met.add(re.sub(r"\s", "", found))
        return exact.get(m[0], squashed.get(found, m[0]))

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        for info in z.infolist():
            name, data = info.filename, z.read(info.filename)
            if THUMBNAIL.match(name):
                continue
            if name.endswith(".rels"):
                text = re.sub(r"<Relationship\b[^>]*thumbnail[^>]*/>", "", data.decode("utf-8"))
                data = re.sub(r'Target="([^"]*)"', lambda m: f'Target="{pattern.sub(stand, m[1])}"' if pattern else m[0], text).encode()
            elif TEXT_PARTS.match(name) or name in ("word/people.xml", "docProps/core.xml", "docProps/app.xml"):
                data = _rewritten(name, data, pattern, stand)
            elif name == "docProps/custom.xml":
                data = re.sub(rb"(<Properties\b[^>]*?)/?>.*", rb"\1/>", data, flags=re.S)
            made.writestr(name, data)
    return out.getvalue(), [v for v in exact if re.sub(r"\s", "", v) not in met]


def _rewritten(name: str, data: bytes, pattern: re.Pattern | None, stand) -> bytes:
    for prefix, uri in re.findall(rb'xmlns:([A-Za-z0-9]+)="([^"]+)"', data):
        if not re.fullmatch(rb"ns[0-9]+", prefix):
            ElementTree.register_namespace(prefix.decode(), uri.decode())
    root = ElementTree.fromstring(data)
    if name.startswith("docProps/"):
        for node in root.iter():
            if node.tag.rpartition("}")[2] in META_TAGS:
                node.text = ""
    for node in root.iter():
        for key in list(node.attrib):
            if key.rpartition("}")[2] in AUTHOR_ATTRIBUTES:
                node.set(key, AUTHOR)
    groups: dict[int, list[ElementTree.Element]] = {}
    for paragraph, node in _walk(root):
        groups.setdefault(paragraph, []).append(node)
    for nodes in groups.values() if pattern else ():
        whole, at, edges = "".join(n.text or "" for n in nodes), 0, []
        for n in nodes:
            edges.append((at, at + len(n.text or "")))
            at = edges[-1][1]
        found = [(m.start(), m.end(), stand(m)) for m in pattern.finditer(whole)]
        if not found:
            continue
        for n, (r0, r1) in zip(nodes, edges, strict=True):
            out, pos = [], r0
            for s, e, repl in found:
                if s < r1 and e > r0:
                    out += [whole[pos : max(pos, s)], repl if s >= r0 else ""]
                    pos = min(e, r1)
            n.text = "".join(out) + whole[pos:r1]
            n.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def masked_packages(packages: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, content and unmapped of packages (doc_id, content) with values (doc_id, value, repl) replaced."""
    lists = values.groupBy("doc_id").agg(F.collect_list(F.struct("value", "repl")).alias("pairs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, content, pairs in zip(batch["doc_id"], batch["content"], batch["pairs"], strict=True):
                if is_package(content):
                    rows.append((key, *mask_package(content, [(p["value"], p["repl"]) for p in ([] if pairs is None else pairs)])))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "unmapped"])

    return packages.select("doc_id", "content").join(lists, "doc_id", "left").mapInPandas(run, "doc_id long, content binary, unmapped array<string>")


def parts(packages: DataFrame) -> DataFrame:
    """doc_id, part and xml (null for binary parts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, content in zip(batch["doc_id"], batch["content"], strict=True):
                if is_package(content):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        yield pd.DataFrame([(key, n, z.read(n).decode("utf-8", "replace") if n.endswith((".xml", ".rels")) else None) for n in z.namelist()], columns=["doc_id", "part", "xml"])

    return packages.select("doc_id", "content").mapInPandas(run, "doc_id long, part string, xml string")


def risks(rows: DataFrame) -> DataFrame:
    """doc_id, images, embedded, revisions and thumbnail of parts, and warnings about them."""
    own = rows.groupBy("doc_id").agg(F.count_if(F.col("part").startswith("word/media/")).alias("images"), F.count_if(F.col("part").startswith("word/embeddings/")).alias("embedded"), F.coalesce(F.bool_or(F.col("xml").rlike("<w:(?:ins|del)[ >]")), F.lit(False)).alias("revisions"), F.bool_or(F.col("part").rlike(r"^docProps/thumbnail\.")).alias("thumbnail"))
    warn = F.array_compact(F.array(F.when(F.col("revisions"), "tracked changes"), F.when(F.col("images") > 0, "images"), F.when(F.col("embedded") > 0, "embedded objects"), F.when(F.col("thumbnail"), "thumbnail removed")))
    return own.withColumn("warnings", warn)


def residual(rows: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id and value of values that are still in some part's XML or in a paragraph's joined text."""
    flat = rows.filter("xml IS NOT NULL").withColumn("plain", F.regexp_replace("xml", "<[^>]*>", ""))
    return flat.join(values, "doc_id").filter(F.col("xml").contains(F.col("value")) | F.col("plain").contains(F.col("value"))).select("doc_id", "value").distinct()
