"""Documents as ordered element rows: splitting, sections, headings, numbering review, quality, export."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

# Fixed patterns of legal structure.
CHAPTER, ARTICLE = r"(?iU)^\s*CHƯƠNG\s+[IVXLCDM]+\b", r"(?iU)^\s*Điều\s+\d+[A-Za-z]?\b"
NUMBERED = r"(?iU)^(?:(Điều)\s+(\d+)\b|(CHƯƠNG)\s+([IVXLCDM]+)\b)"

#: Longest heading in plain text.
HEADING = 120
#: Page classification thresholds (fixed values).
LIMITS = {"chars": 40, "blocks": 1, "printable": 0.95, "invalid": 0.03, "quality": 0.85, "density": 5e-5, "scan": 0.70, "hybrid": 0.08}


def from_text(docs: DataFrame) -> DataFrame:
    """document_id, order, element_type, text: one element a non-blank line; of lines up to HEADING characters, the first one and those in capitals are headings."""
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    lines = lines.withColumn("text", F.trim("text")).where("text <> ''")
    heading = ((F.col("line") == 0) | is_upper(F.col("text"))) & (F.length("text") <= HEADING)
    return renumbered(lines.withColumn("element_type", F.when(heading, "heading").otherwise("paragraph")), "line").select("document_id", "order", "element_type", "text")


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{L}") & ~text.rlike(r"\p{Ll}")


def renumbered(rows: DataFrame, by: str) -> DataFrame:
    """``order`` 0..n-1 within each document, in the order of ``by``."""
    return rows.withColumn("order", F.row_number().over(Window.partitionBy("document_id").orderBy(by)) - 1)


def element_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("element_id", F.concat(F.col("document_id").cast("string"), F.lit("-e"), (F.col("order") + 1).cast("string")))


def with_sections(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """section_id: the last heading's slug, unless present. The legacy form has no ordinal and skips empty slugs."""
    value = F.nullif(X.slug(F.col("text")), F.lit("")) if legacy else X.section_slug(F.col("text"), F.col("order"))
    started = F.when(F.col("element_type") == "heading", value)
    carried = F.last(started, ignorenulls=True).over(Window.partitionBy("document_id").orderBy("order"))
    given = F.nullif(F.col("section_id"), F.lit("")) if "section_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("section_id", F.coalesce(given, carried))


def numbering_review(headings: DataFrame) -> DataFrame:
    """Headings whose article or chapter number breaks the sequence, with what was expected.

    A break does not move the sequence, so the ith heading of a kind is expected to carry the first one's number
    plus i - 1: a window, no state.
    """
    found = headings.withColumn("_a", F.regexp_extract("text", NUMBERED, 2)).withColumn("_c", F.upper(F.regexp_extract("text", NUMBERED, 4)))
    kind = F.when(F.col("_a") != "", "article").when(F.col("_c") != "", "chapter")
    numbered = found.withColumn("kind", kind).where("kind is not null").withColumn("number", F.when(F.col("kind") == "article", F.col("_a").cast("int")).otherwise(X.roman_value(F.col("_c"))))
    w = Window.partitionBy("document_id", "kind").orderBy("order")
    placed = numbered.withColumn("nth", F.row_number().over(w)).withColumn("expected", F.first("number").over(w) + F.col("nth") - 1)
    suggested = F.when(F.col("kind") == "article", F.col("expected").cast("string")).otherwise(X.roman_text(F.col("expected")))
    return placed.where((F.col("nth") > 1) & (F.col("number") != F.col("expected"))).select("document_id", "order", "kind", "number", "expected", suggested.alias("suggested"))


def confirmed_numbers(issues: DataFrame, readings: DataFrame, least_confidence: float = 0.8, agreement: int = 2) -> DataFrame:
    """issues with ``status``: corrected when readings of the crop at enough different scales agree with the suggestion."""
    pattern = F.when(F.col("kind") == "article", F.regexp_extract("reading", r"(?iU)^Điều\s+(\d+)\b", 1)).otherwise(F.upper(F.regexp_extract("reading", r"(?iU)^CHƯƠNG\s+([IVXLCDM]+)\b", 1)))
    joined = issues.join(readings, ["document_id", "order"], "left")
    agreeing = F.when((pattern == F.col("suggested")) & (F.col("confidence") >= least_confidence), F.col("scale"))
    counted = joined.groupBy(*issues.columns).agg(F.count_distinct(agreeing).alias("agreeing"))
    return counted.withColumn("status", F.when(F.col("agreeing") >= agreement, "corrected_by_crop_ocr").otherwise("needs_review"))


def retrieval_headings(levels: list, types: list, texts: list) -> list[list[str]]:
    """Heading path of each element: explicit levels nest, a chapter starts anew, an article sits under its chapter, capitals title the chapter."""
    path: list[tuple[str, str, int | None]] = []
    out = []
    chapter, article = re.compile(r"\s*CHƯƠNG\s+[IVXLCDM]+\b", re.I), re.compile(r"\s*Điều\s+\d+[A-Za-z]?\b", re.I)
    for level, kind, text in zip(levels, types, texts):
        if kind == "heading":
            nested = level is not None and level == level and level > 0
            capitals = any(c.isalpha() for c in text) and not any(c.islower() for c in text)
            if nested:
                path = [p for p in path if p[2] is None or p[2] < level] + [("heading", text, int(level))]
            elif chapter.match(text):
                path = [("chapter", text, None)]
            elif article.match(text):
                path = [p for p in path if p[0] not in ("article", "heading")] + [("article", text, None)]
            elif path and path[0][0] == "chapter" and capitals:
                path = [p for p in path if p[0] != "chapter_title"] + [("chapter_title", text, None)]
            else:
                path = [("heading", text, None)]
        out.append([p[1] for p in path])
    return out


def context_headings(levels: list, types: list, texts: list) -> list[list[str]]:
    """Heading path as a plain stack of levels; 1 where none is given."""
    path: list[tuple[int, str]] = []
    out = []
    for level, kind, text in zip(levels, types, texts):
        if kind == "heading" and text.strip():
            depth = int(level) if level is not None and level == level and level > 0 else 1
            path = [p for p in path if p[0] < depth] + [(depth, text.strip())]
        out.append([p[1] for p in path])
    return out


def with_heading_paths(rows: DataFrame, rule=retrieval_headings) -> DataFrame:
    """document_id, order and heading_path. The path depends on all earlier headings, so each document is folded in one task; only its headings' columns travel."""
    level = F.col("heading_level").cast("int") if "heading_level" in rows.columns else F.lit(None).cast("int")
    slim = rows.select("document_id", "order", "element_type", F.when(F.col("element_type") == "heading", F.col("text")).otherwise("").alias("text"), level.alias("heading_level"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        return pd.DataFrame({"document_id": pdf["document_id"], "order": pdf["order"], "heading_path": rule(pdf["heading_level"].tolist(), pdf["element_type"].tolist(), pdf["text"].tolist())})

    kind = dict(rows.dtypes)["document_id"]
    return slim.groupBy("document_id").applyInPandas(fold, f"document_id {kind}, order int, heading_path array<string>")


def page_type(text: Column, blocks: Column, images: Column, coverage: Column, page_area: Column) -> dict[str, Column]:
    """page_type, blank and whether the text is usable."""
    m, n, trimmed = X.text_metrics(text), LIMITS, F.length(F.trim(text))
    sound = (m["quality"] >= n["quality"]) & (m["invalid_ratio"] <= n["invalid"])
    usable = (trimmed >= n["chars"]) & (blocks >= n["blocks"]) & (m["printable_ratio"] >= n["printable"]) & sound & (trimmed / F.greatest(page_area, F.lit(1.0)) >= n["density"])
    blank = (trimmed == 0) & (images == 0)
    kind = F.when(blank, "digital").when(~usable & (~((trimmed > 0) & sound) | (coverage >= n["scan"])), "scanned").when((images > 0) & (coverage >= n["hybrid"]), "hybrid").otherwise("digital")
    return {"page_type": kind, "blank": blank, "usable": usable}


def needs_ocr(text: Column, blank: Column) -> Column:
    m = X.text_metrics(text)
    return ~blank & ((F.trim(text) == "") | (m["printable_ratio"] < LIMITS["printable"]) | (m["invalid_ratio"] > LIMITS["invalid"]) | (m["quality"] < LIMITS["quality"]))


def quality_report(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row a document: counts, character quality of all text but images', warnings in a fixed order, and status.

    Metrics are sums over elements (lengths, invalid and printable characters), so no document's text is
    concatenated; the line breaks between elements count as printable.
    """
    text = F.when(F.col("element_type") != "image", F.coalesce("text", F.lit("")))
    m = X.text_metrics(text)
    size = F.length(text)
    sums = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("element_count"), F.count(text).alias("texts"), F.coalesce(F.sum(size), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(m["invalid_ratio"] * size), F.lit(0.0)).alias("invalid"), F.coalesce(F.sum(m["printable_ratio"] * size), F.lit(0.0)).alias("printable"),
        F.coalesce(F.bool_or(F.trim(text) != ""), F.lit(False)).alias("has_text"),
    )
    breaks = F.greatest(F.col("texts") - 1, F.lit(0))
    length = F.col("chars") + breaks
    ratio = F.when(length > 0, F.col("invalid") / F.when(length > 0, length)).otherwise(0.0)
    printable = F.when(length > 0, (F.col("printable") + breaks) / F.when(length > 0, length)).otherwise(1.0)
    out = sums.select("document_id", "element_count", length.alias("text_length"), ratio.alias("invalid_char_ratio"), F.greatest(F.lit(0.0), printable * (1 - ratio)).alias("text_quality_score"), "has_text")
    if pages is not None:
        failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("page_number"))))
        out = out.join(pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), failed.alias("failed_pages")), "document_id", "full")
    else:
        out = out.withColumn("page_count", F.lit(0).cast("long")).withColumn("failed_pages", F.expr("cast(array() as array<int>)"))
    failed = F.coalesce("failed_pages", F.expr("cast(array() as array<int>)"))
    warnings = F.array_compact(F.array(
        F.when(F.coalesce("element_count", F.lit(0)) == 0, "Document contains no elements"),
        F.when(~F.coalesce("has_text", F.lit(False)), "No text extracted; inspect image assets or blank pages"),
        F.when(F.col("invalid_char_ratio") > LIMITS["invalid"], "Invalid character ratio exceeds threshold"),
        F.when(F.size(failed) > 0, F.concat(F.lit("Pages failed: ["), F.array_join(failed.cast("array<string>"), ", "), F.lit("]"))),
    ))
    return out.withColumn("warnings", warnings).withColumn("status", F.when(F.size("warnings") > 0, "partial").otherwise("ok")).drop("has_text")


def repeated_noise(rows: DataFrame, page: str = "page_number") -> DataFrame:
    """document_id, key of header and footer texts that stand on two pages or more."""
    key = F.lower(F.regexp_replace(F.trim("text"), r"(?U)\s+", " "))
    edges = rows.where(F.col("element_type").isin("header", "footer") & (F.trim("text") != "") & F.col(page).isNotNull())
    return edges.groupBy("document_id", key.alias("key")).agg(F.count_distinct(page).alias("n_pages")).where("n_pages >= 2")


def markdown(rows: DataFrame) -> DataFrame:
    """document_id, markdown: a marker where the page or sheet changes, headings by level 1 to 6, tables as their Markdown."""
    w = Window.partitionBy("document_id").orderBy("order")
    shown = rows.where(~F.coalesce("excluded", F.lit(False))) if "excluded" in rows.columns else rows
    page = F.col("page_number") if "page_number" in rows.columns else F.lit(None).cast("int")
    seen = F.last(page, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = shown.withColumn("_p", page).withColumn("_new", F.col("_p").isNotNull() & ~F.col("_p").eqNullSafe(seen))
    level = F.least(F.greatest(F.coalesce(F.col("heading_level").cast("int") if "heading_level" in rows.columns else F.lit(None).cast("int"), F.lit(1)), F.lit(1)), F.lit(6))
    body = F.when(F.col("element_type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    line = F.concat(F.when(F.col("_new"), F.concat(F.lit("<!-- page "), F.col("_p").cast("string"), F.lit(" -->\n\n"))).otherwise(""), body)
    parts = marked.select("document_id", "order", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("order", "line")))
    return parts.groupBy("document_id").agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n\n"), F.lit("\n")).alias("markdown"))


def structured_json(rows: DataFrame) -> DataFrame:
    """document_id, page_number, blocks: JSON of a page's elements in reading order; confidence is the layout's, else the OCR's."""
    confidence = F.coalesce(*[F.col(c) for c in ("layout_confidence", "ocr_confidence") if c in rows.columns], F.lit(None).cast("double"))
    block = F.struct(F.col("order").alias("reading_order"), F.col("element_type").alias("type"), F.col("text"), confidence.alias("confidence"))
    return rows.groupBy("document_id", "page_number").agg(F.to_json(F.array_sort(F.collect_list(block))).alias("blocks"))


def contract_violations(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, rule, value of every broken constraint: unique ids and pages, known parents and pages, ordered boxes."""
    doubled = rows.groupBy("document_id", "element_id").count().where("count > 1").select("document_id", F.lit("duplicate element id").alias("rule"), F.col("element_id").alias("value"))
    twice = pages.groupBy("document_id", "page_number").count().where("count > 1").select("document_id", F.lit("duplicate page number").alias("rule"), F.col("page_number").cast("string").alias("value"))
    ids = rows.select("document_id", F.col("element_id").alias("parent_id"))
    orphans = rows.where("parent_id is not null").join(ids, ["document_id", "parent_id"], "left_anti").select("document_id", F.lit("unknown parent").alias("rule"), F.col("parent_id").alias("value"))
    lost = rows.where("page_number is not null").join(pages, ["document_id", "page_number"], "left_anti").select("document_id", F.lit("unknown page").alias("rule"), F.col("element_id").alias("value"))
    out = doubled.unionByName(twice).unionByName(orphans).unionByName(lost)
    if "bbox" in rows.columns:
        b = F.col("bbox")
        wrong = rows.where(b.isNotNull() & ((b["x0"] > b["x1"]) | (b["y0"] > b["y1"])))
        out = out.unionByName(wrong.select("document_id", F.lit("box out of order").alias("rule"), F.col("element_id").alias("value")))
    return out


def retrieval_elements(rows: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """Elements fit for retrieval: no headers, footers or excluded ones, images only with a usable caption, with heading paths and embedding text.

    ``captions``: element_id, document_id, status, retrieval_useful, display. A caption of another document is an error.
    """
    live = rows.where(~F.coalesce("excluded", F.lit(False))) if "excluded" in rows.columns else rows
    live = live.where(~F.col("element_type").isin("header", "footer"))
    if captions is not None:
        usable = captions.where(F.col("status").isin("completed", "needs_review") & F.coalesce("retrieval_useful", F.lit(False)))
        c = usable.select("element_id", F.col("document_id").alias("_cd"), F.col("display").alias("_caption"))
        live = live.join(c, "element_id", "left")
        clash = F.col("_cd").isNotNull() & (F.col("_cd") != F.col("document_id"))
        live = live.withColumn("_caption", F.when(clash, F.raise_error(F.concat(F.lit("Caption document mismatch for "), F.col("element_id")))).otherwise(F.col("_caption")))
        image = F.col("element_type") == "image"
        live = live.where(~image | F.col("_caption").isNotNull()).withColumn("text", F.when(image, F.col("_caption")).otherwise(F.col("text"))).drop("_cd", "_caption")
    else:
        live = live.where(F.col("element_type") != "image")
    live = live.where(F.trim("text") != "")
    return live.join(with_heading_paths(live), ["document_id", "order"]).withColumn("text_for_embedding", X.embedding_text(F.col("heading_path"), F.col("text")))


def postprocessing_stats(elements: DataFrame) -> DataFrame:
    """document_id, changed_elements, excluded_page_numbers, review_issue_count. ``elements``: changes, exclusion_reason, issues (arrays of structs, issues with a status)."""
    return elements.groupBy("document_id").agg(
        F.count_if(F.coalesce(F.size("changes"), F.lit(0)) > 0).alias("changed_elements"),
        F.count_if(F.coalesce(F.col("exclusion_reason") == "page_number", F.lit(False))).alias("excluded_page_numbers"),
        F.sum(F.size(F.filter(F.coalesce("issues", F.array().cast("array<struct<status:string>>")), lambda i: F.coalesce(i["status"] == "needs_review", F.lit(False))))).alias("review_issue_count"),
    )
