"""Images: surrounding text, caption review and caching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import numbered

ELIGIBLE = ["heading", "paragraph", "list", "table", "formula"]
SIDE, TOTAL = 100, 200
PLACEHOLDER = r"(?iU)\b(?:placeholder|lorem ipsum|image description unavailable)\b|^\s*(?:n/?a|unknown|không rõ)\s*$"
LEAKAGE = r"(?i)(?:ignore (?:all|previous) instructions|system prompt|developer message)"


def allocated(before: int, after: int, side: int = SIDE, total: int = TOTAL) -> tuple[int, int]:
    """Tokens taken on each side: half each, what one side lacks goes to the other, first to the side before."""
    b, a = min(side, before), min(side, after)
    b += min(total - a - b, before - b)
    return b, a + min(total - a - b, after - a)


def contexts(elements: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """document_id, element_id of every image with before, after (the nearest words) and their numbers.

    Only the nearest TOTAL words of an element can matter, so longer texts are cut before they travel.
    """
    text = F.when(F.col("element_type").isin(ELIGIBLE) & ~F.coalesce(F.col("excluded") if "excluded" in elements.columns else F.lit(False), F.lit(False)), F.trim("text"))
    rows = elements.withColumn("_w", F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    if noise is not None:
        key = F.lower(F.regexp_replace(F.trim("text"), r"(?U)\s+", " "))
        n = noise.select("document_id", F.col("key").alias("_k")).withColumn("_noise", F.lit(True))
        rows = rows.withColumn("_k", key).join(n, ["document_id", "_k"], "left").withColumn("_w", F.when(F.col("_noise"), F.array().cast("array<string>")).otherwise(F.col("_w")))
    n = F.size("_w")
    slim = rows.select("document_id", "element_id", "order", (F.col("element_type") == "image").alias("is_image"), F.slice("_w", F.lit(1), F.lit(TOTAL)).alias("head"), F.slice("_w", F.greatest(n - TOTAL + 1, F.lit(1)), F.lit(TOTAL)).alias("tail"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable").reset_index(drop=True)
        heads, tails, out = [list(x) for x in pdf["head"]], [list(x) for x in pdf["tail"]], []
        for i in pdf.index[pdf["is_image"]]:
            before, after, j, k = [], [], i - 1, i + 1
            while j >= 0 and len(before) < TOTAL:
                before, j = tails[j] + before, j - 1
            while k < len(pdf) and len(after) < TOTAL:
                after, k = after + heads[k], k + 1
            before, after = before[-TOTAL:], after[:TOTAL]
            b, a = allocated(len(before), len(after))
            out.append((pdf["document_id"].iloc[0], pdf["element_id"].iloc[i], " ".join(before[len(before) - b :]), " ".join(after[:a]), b, a))
        return pd.DataFrame(out, columns=["document_id", "element_id", "before", "after", "n_before", "n_after"])

    kind = dict(elements.dtypes)["document_id"]
    return slim.groupBy("document_id").applyInPandas(fold, f"document_id {kind}, element_id string, before string, after string, n_before int, n_after int")


def unreliable_anchors(elements: DataFrame) -> DataFrame:
    """Images whose order another element shares."""
    shared = F.count(F.lit(1)).over(Window.partitionBy("document_id", "order"))
    return elements.withColumn("_n", shared).where((F.col("element_type") == "image") & (F.col("_n") > 1)).drop("_n")


def review_reasons(context: Column) -> Column:
    """Why a caption needs review. Columns: title, caption, visible_text, uncertainties, steps, relationships, chart_details, image_type, retrieval_useful, contextual_relevance."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    text = F.trim(F.concat_ws(" ", "title", "caption", "visible_text", "uncertainties"))
    plain = lambda t: F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))
    echoed = none("uncertainties") & (context != "") & F.exists("visible_text", lambda v: (F.length(plain(v)) >= 12) & plain(context).contains(plain(v)))
    return F.array_compact(F.array(
        F.when(text.rlike(PLACEHOLDER), "placeholder_or_non_description"),
        F.when(text.rlike(LEAKAGE), "possible_instruction_leakage"),
        F.when(F.col("image_type").isin("logo", "seal") & F.col("retrieval_useful"), "decorative_type_marked_retrieval_useful"),
        F.when((F.col("image_type") == "chart") & (F.coalesce("chart_details", F.lit("")) == "") & none("uncertainties"), "chart_missing_details_or_uncertainty"),
        F.when((F.col("image_type") == "flowchart") & none("steps") & none("relationships"), "flowchart_missing_structure"),
        F.when((F.coalesce("contextual_relevance", F.lit("")) != "") & (F.coalesce("caption", F.lit("")) == "") & none("visible_text"), "context_only_without_visual_description"),
        F.when(echoed, "visible_text_matches_context_without_uncertainty"),
    ))


def figure_text() -> Column:
    """A caption's display text: title, caption, visible text, steps, relationships and chart details, one a line."""
    each = lambda label, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(label + ": "), x))
    seen = F.when(F.coalesce(F.size("visible_text"), F.lit(0)) > 0, F.concat(F.lit("Văn bản nhìn thấy: "), F.array_join("visible_text", "; ")))
    details = F.when(F.coalesce("chart_details", F.lit("")) != "", F.concat(F.lit("Chi tiết biểu đồ: "), F.col("chart_details")))
    lines = F.concat(F.array(F.trim("title"), F.trim("caption"), seen), each("Các bước", "steps"), each("Các quan hệ", "relationships"), F.array(details))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def from_cache(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def caption_gate(captions: DataFrame, images: DataFrame) -> DataFrame:
    """rule, n of what stops a run: unfinished captions, doubled ones, images without one."""
    rules = [
        captions.where(F.col("status").isin("pending", "error")).select(F.lit("unfinished").alias("rule")),
        captions.groupBy("element_id").count().where("count > 1").select(F.lit("duplicate").alias("rule")),
        images.join(captions, "element_id", "left_anti").select(F.lit("missing").alias("rule")),
    ]
    return rules[0].unionByName(rules[1]).unionByName(rules[2]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def pilot_sample(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each stratum, evenly spaced in ``order``, an integer column."""
    placed = numbered(rows, [by], order).withColumn("_i", F.col("_i") - 1)
    slot = F.floor(F.col("_i") * n / F.col("_n"))
    before = F.floor((F.col("_i") - 1) * n / F.col("_n"))
    return placed.where((F.col("_n") <= n) | (F.col("_i") == 0) | (slot != before)).drop("_i", "_n")


def image_urls(chunks: DataFrame, base: str) -> DataFrame:
    """chunk_id, source_index, image_index, url: flattened images of retrieved chunks."""
    s = chunks.withColumn("source_index", F.col("rank") - 1).select("chunk_id", "source_index", F.posexplode("images").alias("image_index", "image"))
    return s.select("chunk_id", "source_index", "image_index", F.concat(F.lit(base.rstrip("/") + "/"), F.url_encode("chunk_id"), F.lit("/"), F.col("image_index").cast("string")).alias("url"))


def shown_once(images: DataFrame, order: list[str]) -> DataFrame:
    """The first image, by ``order``, of each document, page and picture.

    A document is named by doc_id or else file_name, a picture by image_hash, path or element_id, whichever is not blank
    first. One aggregate whose partial results meet before the shuffle, so a picture repeated everywhere is no hot key.
    """
    given = lambda *cs: F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in cs])
    keyed = images.select(given("doc_id", "file_name").alias("_d"), F.col("page").alias("_p"), given("image_hash", "path", "element_id").alias("_i"), F.struct("*").alias("_r"))
    first = F.min_by("_r", F.struct(*[F.col("_r")[c] for c in order])).alias("_r")
    return keyed.groupBy("_d", "_p", "_i").agg(first).select("_r.*")


_PARTS = "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>, candidates array<struct<finishReason:string,content:struct<parts:array<struct<text:string>>>>>, promptFeedback struct<blockReason:string>"
#: Fixed values of the two services' answers.
TEXT_TYPES, CLIPPED = ["output_text", "text"], ["MAX_TOKENS", "MALFORMED_FUNCTION_CALL"]


def answer_text(payload: Column, candidates: bool) -> Column:
    """(text, error) of a vision model's JSON answer: of candidates with parts, or of output items with contents. One of the two is null."""
    p = F.from_json(payload, _PARTS)
    texts = lambda found: F.filter(F.transform(F.coalesce(found, F.array().cast("array<struct<text:string>>")), lambda x: x["text"]), lambda t: t.isNotNull())
    if candidates:
        first = F.get(p["candidates"], F.lit(0))
        found = texts(first["content"]["parts"])
        stop = F.when(first.isNull(), F.concat(F.lit("no candidates: "), F.coalesce(p["promptFeedback"]["blockReason"], F.lit("no reason given"))))
        stop = F.coalesce(stop, F.when(first["finishReason"].isin(CLIPPED), F.concat(F.lit("clipped: "), first["finishReason"])))
    else:
        items = F.flatten(F.filter(F.transform(p["output"], lambda o: o["content"]), lambda c: c.isNotNull()))
        listed = texts(F.transform(F.filter(items, lambda c: c["type"].isin(TEXT_TYPES)), lambda c: F.struct(c["text"].alias("text"))))
        found, stop = F.when(p["output_text"].isNotNull(), F.array(p["output_text"])).otherwise(listed), F.lit(None).cast("string")
    error = F.coalesce(stop, F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, F.lit("no text")))
    return F.struct(F.when(error.isNull(), F.array_join(found, "")).alias("text"), error.alias("error"))


def caption_fields(answer: Column, schema: str, required: list[str]) -> Column:
    """(caption, error): the answer's JSON under a schema; text that is no such JSON, or lacks a required field, is an error row, not a failure."""
    got = F.from_json(answer, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    lacking = F.array_compact(F.array(*[F.when(got[c].isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    error = F.when(got.isNull() | got["_broken"].isNotNull(), F.lit("not valid JSON")).when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    return F.struct(F.when(error.isNull(), got.dropFields("_broken")).alias("caption"), error.alias("error"))
