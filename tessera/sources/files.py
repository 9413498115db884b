"""Files: discovery, validation, routing, and parsers for what the standard library can open. Recognition and models plug in by protocol."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extension to format.
FORMATS = {"pdf": "pdf", "docx": "docx", "xlsx": "excel", "xlsm": "excel", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image"}
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
ELEMENT = "document_id string, path string, position int, element_type string, text string, page_number int, heading_level int, status string, error string"
CELL = "document_id string, path string, sheet string, row int, column int, coordinate string, value string, formula string"
SHEET = "document_id string, path string, sheet string, state string, merged_cells array<string>, hidden_rows array<int>, hidden_columns array<string>"
CELL_CAP = 1_000_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_format(path: Column) -> Column:
    """The format of a path's extension; null if unsupported."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), extension(path))


def mime(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), extension(path)), F.lit("application/octet-stream"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, format of all supported files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", file_format(F.col("path")).alias("format")).where("format is not null")


def rejected(files: DataFrame) -> DataFrame:
    reason = F.when(file_format(F.col("path")).isNull(), "unsupported").when(F.col("length") == 0, "empty")
    return files.withColumn("reason", reason).where("reason is not null")


def document_id(content: Column) -> Column:
    """The first 20 hexadecimal digits of the file's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 20)


def docx_elements(raw: bytes) -> Iterator[tuple[str, str, int | None]]:
    """(element_type, text, heading_level) in the order of the document body; tables as Markdown."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = re.fullmatch(r"(?i)heading\s*(\d+)", name)
            if node.find(f".//{_W}drawing") is not None:
                yield "image", text(node).strip(), None
            elif text(node).strip():
                kind = "heading" if level or name.lower() == "title" else "list" if node.find(f"{_W}pPr/{_W}numPr") is not None else "paragraph"
                yield kind, text(node).strip(), int(level[1]) if level else None
        elif node.tag == f"{_W}tbl":
            rows = [["".join(text(c)).strip().replace("|", "\\|").replace("\n", "<br>") for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            yield "table", "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]), None


def xlsx_cells(raw: bytes, cap: int = CELL_CAP) -> Iterator[tuple[str, int, int, str, str, str | None]]:
    """(sheet, row, column, coordinate, value, formula) of every cell with a value or formula."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    seen = 0
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = links[sheet.get(f"{_R}id")].lstrip("/")
        for c in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}c"):
            seen += 1
            if seen > cap:
                raise ValueError(f"the workbook has more than {cap} cells")
            value, formula, kind = c.find(f"{_S}v"), c.find(f"{_S}f"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            if text is None and formula is None:
                continue
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            column = 0
            for letter in letters:
                column = column * 26 + ord(letter) - 64
            yield sheet.get("name"), int(row), column, c.get("r"), text, None if formula is None else "=" + (formula.text or "")


def xlsx_sheets(raw: bytes) -> Iterator[tuple[str, str, list[str], list[int], list[str]]]:
    """(sheet, state, merged ranges, hidden rows, hidden columns) of every sheet of a workbook."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = links[sheet.get(f"{_R}id")]
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        hidden = lambda tag: [e for e in root.iter(f"{_S}{tag}") if e.get("hidden") in ("1", "true")]  # noqa: B023, E731
        columns = [_letters(k) for c in hidden("col") for k in range(int(c.get("min")), int(c.get("max")) + 1)]
        yield sheet.get("name"), sheet.get("state") or "visible", [m.get("ref") for m in root.iter(f"{_S}mergeCell")], [int(r.get("r")) for r in hidden("row")], columns


def _letters(column: int) -> str:
    """A column's letters: 1 is A, 27 is AA."""
    return (_letters((column - 1) // 26) if column > 26 else "") + chr(65 + (column - 1) % 26)


def image_elements(raw: bytes, recognise: Callable[[bytes], Iterator[tuple[str, str, int | None]]] | None = None) -> Iterator[tuple[str, str, int | None]]:
    """The picture itself as an element, then what a recogniser reads in it. Bytes of no known picture format are an error."""
    if not raw.startswith((b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"II*\x00", b"MM\x00*", b"BM", b"GIF8")) and not (raw[:4] == b"RIFF" and raw[8:12] == b"WEBP"):
        raise ValueError("not a picture")
    yield "image", "", None
    yield from recognise(raw) if recognise else ()


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], Iterator[tuple]]] | None = None) -> DataFrame:
    """ELEMENT rows of binary files. A file that fails becomes one row of status ``failed``; the others are not touched.

    ``parsers`` adds or replaces formats (PDF, image with a recogniser) by functions of the file's bytes; a format without one fails its files.
    """
    known = {"docx": docx_elements, "image": image_elements} | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ELEMENT.split(", ")]
        for batch in batches:
            for path, raw, doc, kind in batch.itertuples(index=False):
                try:
                    if kind not in known:
                        raise ValueError(f"no parser for {kind}")
                    rows = [(doc, path, i, t, x, None, level, "ok", None) for i, (t, x, level) in enumerate(known[kind](bytes(raw)))]
                except Exception as error:  # one bad file must not end the batch
                    rows = [(doc, path, 0, "unknown", "", None, None, "failed", f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=names).astype({"page_number": "Int32", "heading_level": "Int32"})

    return files.select("path", "content", document_id(F.col("content")).alias("doc"), file_format(F.col("path")).alias("kind")).mapInPandas(run, ELEMENT)


def cells(files: DataFrame) -> DataFrame:
    """CELL rows of the workbooks among binary files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw, doc in batch.itertuples(index=False):
                yield pd.DataFrame([(doc, path, *c) for c in xlsx_cells(bytes(raw))], columns=[c.split()[0] for c in CELL.split(", ")])

    return files.where(file_format(F.col("path")) == "excel").select("path", "content", document_id(F.col("content")).alias("doc")).mapInPandas(run, CELL)


def sheets(files: DataFrame) -> DataFrame:
    """SHEET rows of the workbooks among binary files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw, doc in batch.itertuples(index=False):
                yield pd.DataFrame([(doc, path, *s) for s in xlsx_sheets(bytes(raw))], columns=["document_id", "path", "sheet", "state", "merged_cells", "hidden_rows", "hidden_columns"])

    return files.where(file_format(F.col("path")) == "excel").select("path", "content", document_id(F.col("content")).alias("doc")).mapInPandas(run, SHEET)


def merged_ranges(found: DataFrame) -> DataFrame:
    """document_id, sheet, row1, column1, row2, column2 of the merged ranges of SHEET rows, as ``table_regions`` takes them."""
    part = lambda g: F.regexp_extract("ref", r"^([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?$", g)
    number = lambda letters: F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: n * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64))
    end = lambda g: F.when(part(g) == "", part(g - 2)).otherwise(part(g))
    each = found.select("document_id", "sheet", F.explode("merged_cells").alias("ref"))
    return each.select("document_id", "sheet", part(2).cast("int").alias("row1"), number(part(1)).alias("column1"), end(4).cast("int").alias("row2"), number(end(3)).alias("column2"))


def json_safe(frame: DataFrame) -> DataFrame:
    """Every column as JSON can hold it: dates and times in ISO form, strings, numbers and booleans as they are, all else as strings."""

    def safe(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            fraction = F.date_format(c, "SSSSSS")
            return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))
        return c if kind in ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double") else c.cast("string")

    return frame.select(*[safe(n, k).alias(n) for n, k in frame.dtypes])


def batch_counts(parsed: DataFrame) -> DataFrame:
    """One row: files ok, partial and failed."""
    each = parsed.groupBy("path").agg(F.count_if(F.col("status") == "failed").alias("bad"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.count_if(F.expr("bad = 0")).alias("ok"), F.count_if(F.expr("bad > 0 and bad < n")).alias("partial"), F.count_if(F.expr("bad = n")).alias("failed"))


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical documents: JSON files under a folder, one document each."""
    schema = "document_id string, filename string, file_type string, elements array<struct<element_id:string,element_type:string,text:string,page_number:int,`order`:int,section_id:string>>"
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, broken ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def demo_questions(questions: DataFrame) -> DataFrame:
    """Questions fit to show: with evidence and a source document, not meant to fall back, each once."""
    fit = ~F.coalesce("expect_fallback", F.lit(False)) & (F.coalesce("expect_contains", F.lit("")) != "") & F.col("source_doc").isNotNull() & F.coalesce("demo", F.lit(True))
    return questions.where(fit & (F.trim("q") != "")).withColumn("q", F.trim("q")).withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("ordinal"))).where("_n = 1").drop("_n")


def random_question(questions: DataFrame, previous: str | None, seed: int) -> DataFrame:
    return questions.where(F.col("q") != F.lit(previous) if previous else F.lit(True)).orderBy(F.rand(seed)).limit(1)
