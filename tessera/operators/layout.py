"""Page layout: recognised lines and blocks, reading order, duplicates, page numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as X

COLUMN_WIDTH, COLUMN_GAP, COLUMN_OVERLAP = 0.18, 0.05, 0.5
DUPLICATE, ASSIGNED, COVERED = 0.8, 0.5, 0.5


def line_blocks(lines: DataFrame, blocks: DataFrame, least: float = ASSIGNED) -> DataFrame:
    """page_id, line_id, block_id, coverage: each line's block of largest coverage (of equal ones the last), if it is enough.

    Both sides are keyed by page, so the comparison stays inside a page.
    """
    pairs = lines.alias("l").join(blocks.alias("b"), F.col("l.page_id") == F.col("b.page_id"))
    c = G.coverage(F.col("l.bbox"), F.col("b.bbox"))
    best = pairs.groupBy(F.col("l.page_id").alias("page_id"), "line_id").agg(F.max(F.struct(c.alias("coverage"), F.col("block_id"))).alias("m"))
    return best.select("page_id", "line_id", "m.block_id", "m.coverage").where(F.col("coverage") >= least)


def block_confidence(lines: DataFrame, assigned: DataFrame) -> DataFrame:
    return lines.join(assigned, ["page_id", "line_id"]).groupBy("page_id", "block_id").agg(F.avg("confidence").alias("ocr_confidence"), F.count(F.lit(1)).alias("n_lines"))


def uncovered_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines that no block holds: neither as a duplicate, nor inside a table or formula, nor within its text."""
    b = blocks.select("page_id", F.col("bbox").alias("_b"), F.col("element_type").alias("_t"), X.compact(F.coalesce("text", F.lit(""))).alias("_c"))
    mine = F.col("_m")
    same = (mine == F.col("_c")) & (G.containment(F.col("bbox"), F.col("_b")) >= DUPLICATE)
    inside = (G.coverage(F.col("bbox"), F.col("_b")) >= COVERED) & (F.col("_t").isin("table", "formula", "equation") | F.col("_c").contains(mine))
    shown = lines.where((F.trim("text") != "") & (G.area(F.col("bbox")) > 0)).withColumnRenamed("page_id", "_page").withColumn("_m", X.compact(F.col("text")))
    return shown.join(b, (F.col("_page") == F.col("page_id")) & (same | inside), "left_anti").withColumnRenamed("_page", "page_id").drop("_m")


def column_pairs(blocks: DataFrame) -> DataFrame:
    """page_id, a, b of text blocks that stand side by side: wide enough, with a gap, at the same height."""
    text = blocks.where(F.col("element_type").isin("text", "paragraph") & (F.col("bbox")["x1"] - F.col("bbox")["x0"] >= F.col("width") * COLUMN_WIDTH))
    l, r = text.alias("l"), text.alias("r")
    a, b = F.col("l.bbox"), F.col("r.bbox")
    gap = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"])
    vertical, height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    beside = (height > 0) & (gap > F.col("l.width") * COLUMN_GAP) & (vertical > height * COLUMN_OVERLAP)
    pairs = l.join(r, (F.col("l.page_id") == F.col("r.page_id")) & (F.col("l.block_id") < F.col("r.block_id")) & beside)
    return pairs.select(F.col("l.page_id").alias("page_id"), F.col("l.block_id").alias("a"), F.col("r.block_id").alias("b"))


def reading_order(blocks: DataFrame, mode: str = "auto") -> DataFrame:
    """``order`` of blocks: from top to bottom on pages of one column, as found on the others."""
    two = column_pairs(blocks).select("page_id").distinct().withColumn("_two", F.lit(True))
    marked = blocks.join(two, "page_id", "left")
    single = F.lit(mode == "single_column") | (F.lit(mode == "auto") & F.col("_two").isNull())
    order = Window.partitionBy("page_id").orderBy(F.when(single, F.col("bbox")["y0"]), F.when(single, F.col("bbox")["x0"]), "block_id")
    return marked.withColumn("order", F.row_number().over(order) - 1).drop("_two")


def page_numbers_retyped(blocks: DataFrame) -> DataFrame:
    """Page numbers become footers and are excluded."""
    hit = G.is_page_number(F.col("text"), F.col("bbox"), F.col("width"), F.col("height"))
    return blocks.withColumns({"original_type": F.when(hit, F.col("element_type")), "exclusion_reason": F.when(hit, "page_number"), "excluded": hit, "element_type": F.when(hit, "footer").otherwise(F.col("element_type"))})


def without_duplicates(blocks: DataFrame) -> DataFrame:
    """page_id, block_id, duplicate_of: a block repeats the first earlier *kept* one with the same text and place.

    Which blocks are kept depends on those before them, so the few blocks of a page and text are folded as one array, in the JVM.
    """
    row = "array<struct<block_id:bigint,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
    nothing = F.struct(F.expr(f"cast(array() as {row})").alias("kept"), F.expr("cast(array() as array<struct<block_id:bigint,duplicate_of:bigint>>)").alias("out"))

    def step(acc: Column, block: Column) -> Column:
        first = F.get(F.filter(acc["kept"], lambda k: G.containment(block["bbox"], k["bbox"]) >= DUPLICATE), F.lit(0))["block_id"]
        kept = F.when(first.isNull(), F.concat(acc["kept"], F.array(block))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.concat(acc["out"], F.array(F.struct(block["block_id"].alias("block_id"), first.alias("duplicate_of")))).alias("out"))

    bbox = F.struct(*[F.col("bbox")[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    placed = blocks.select("page_id", F.col("block_id").cast("bigint").alias("block_id"), X.compact(F.coalesce("text", F.lit(""))).alias("key"), bbox.alias("bbox"))
    grouped = placed.where("key != ''").groupBy("page_id", "key").agg(F.array_sort(F.collect_list(F.struct("block_id", "bbox"))).alias("b"))
    folded = grouped.select("page_id", F.explode(F.aggregate(F.col("b").cast(row), nothing, step, lambda acc: acc["out"])).alias("r"))
    blank = placed.where("key = ''").select("page_id", "block_id", F.lit(None).cast("bigint").alias("duplicate_of"))
    return folded.select("page_id", "r.block_id", "r.duplicate_of").unionByName(blank)


def joined_lines(lines: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """page_id, block_id, text: lines of a block in rows by the height of their middle, each row from left to right.

    A line joins the open row when its middle is near that of the row's first line.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(middle=(pdf["y0"] + pdf["y1"]) / 2, high=pdf["y1"] - pdf["y0"]).sort_values(["middle", "x0"])
        rows: list[list] = []
        for line in pdf.itertuples(index=False):
            if rows and abs(line.middle - rows[-1][0].middle) <= min(line.high, rows[-1][0].high) * tolerance:
                rows[-1].append(line)
            else:
                rows.append([line])
        text = " ".join(line.text.strip() for row in rows for line in sorted(row, key=lambda x: x.x0))
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "block_id": [pdf["block_id"].iloc[0]], "text": [text]})

    flat = lines.select("page_id", "block_id", "text", F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.y1"))
    return flat.groupBy("page_id", "block_id").applyInPandas(fold, "page_id long, block_id long, text string")


def zipped_lines(texts: Column, boxes: Column, scores: Column) -> Column:
    """Array of (text, box, confidence) of parallel recogniser outputs, blank texts dropped."""
    rows = F.transform(F.arrays_zip(texts.alias("t"), boxes.alias("b"), scores.alias("s")), lambda z: F.struct(z["t"].alias("text"), z["b"].alias("bbox"), z["s"].alias("confidence")))
    return F.filter(rows, lambda r: (F.trim(r["text"]) != "") & r["bbox"].isNotNull())


def layout_confidence(elements: DataFrame, detections: DataFrame) -> DataFrame:
    """Each element's confidence: the detection of its id, else of its label with the best IoU, else at its position."""
    e, d = elements, detections
    by_id = d.select("page_id", F.col("detection_id").alias("block_id"), F.col("score").alias("_id"))
    by_place = d.select("page_id", F.col("position").alias("_at"), F.col("score").alias("_pos"))
    overlap = e.alias("e").join(d.alias("d"), (F.col("e.page_id") == F.col("d.page_id")) & (F.col("e.label") == F.col("d.label")))
    value = G.iou(F.col("e.bbox"), F.col("d.bbox"))
    best = overlap.where(value > 0).groupBy(F.col("e.page_id").alias("page_id"), F.col("e.block_id").alias("block_id")).agg(F.max_by(F.col("d.score"), value).alias("_iou"))
    out = e.join(by_id, ["page_id", "block_id"], "left").join(best, ["page_id", "block_id"], "left").join(by_place.withColumnRenamed("_at", "position"), ["page_id", "position"], "left")
    return out.withColumn("layout_confidence", F.coalesce("_id", "_iou", "_pos")).drop("_id", "_iou", "_pos")


def inserted_lines(blocks: DataFrame, recovered: DataFrame) -> DataFrame:
    """page_id, item, order: recovered lines put before the first block below them that shares their columns, else after the last that does."""

    def fold(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        items = [(f"b{r.block_id}", r.x0, r.y0, r.x1) for r in left.sort_values("block_id").itertuples(index=False)]
        for r in right.sort_values(["y0", "x0"]).itertuples(index=False):
            near = [i for i, b in enumerate(items) if min(r.x1, b[3]) > max(r.x0, b[1])] or list(range(len(items)))
            below = next((i for i in near if items[i][2] > r.y0), None)
            items.insert(below if below is not None else (near[-1] + 1 if near else 0), (f"l{r.line_id}", r.x0, r.y0, r.x1))
        return pd.DataFrame({"page_id": [key[0]] * len(items), "item": [i[0] for i in items], "order": range(len(items))})

    flat = lambda df, c: df.select("page_id", c, F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1"))
    return flat(blocks, "block_id").groupBy("page_id").cogroup(flat(recovered, "line_id").groupBy("page_id")).applyInPandas(fold, "page_id long, item string, order int")
