"""Tables: HTML to cells and back, grids, physical order, spreadsheet regions, matching of blocks and results."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as G
from tessera.functions.ranks import numbered

CELL = "row_index int, column_index int, rowspan int, colspan int, is_header boolean, text string"


class _Cells(HTMLParser):
    """Cells with the grid place that row and column spans leave them."""

    def __init__(self):
        super().__init__()
        self.cells, self.taken, self.row, self.column, self.open, self.depth = [], set(), -1, 0, None, 0
        self.nested = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.nested |= self.depth > 0
            self.depth += 1
        elif tag == "tr" and self.depth <= 1:
            self.row, self.column = self.row + 1, 0
        elif tag in ("td", "th") and self.depth <= 1:
            self._end()
            span = {k: max(1, int(v)) if (v or "").isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            row = max(self.row, 0)
            while (row, self.column) in self.taken:
                self.column += 1
            down, across = span.get("rowspan", 1), span.get("colspan", 1)
            self.taken |= {(y, x) for y in range(row, row + down) for x in range(self.column, self.column + across)}
            self.open = [row, self.column, down, across, tag == "th", []]
            self.column += across
        elif tag == "br" and self.open and self.depth <= 1:
            self.open[5].append("\n")

    def handle_data(self, data):
        if self.open:
            self.open[5].append(data)

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        # What ends inside a nested table ends nothing out here; the end of the outer one ends its last cell.
        if self.depth == 0 or (self.depth == 1 and tag in ("td", "th", "tr")):
            self._end()

    def _end(self):
        if self.open:
            lines = (" ".join(line.split()) for line in "".join(self.open[5]).splitlines())
            self.cells.append((*self.open[:5], "\n".join(filter(None, lines))))
        self.open = None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("row_index", T.IntegerType()), T.StructField("column_index", T.IntegerType()), T.StructField("rowspan", T.IntegerType()), T.StructField("colspan", T.IntegerType()), T.StructField("is_header", T.BooleanType()), T.StructField("text", T.StringType())])))
def html_cells(html: pd.Series) -> pd.Series:
    names = [c.split()[0] for c in CELL.split(", ")]

    def one(source: str | None) -> list[dict]:
        parser = _Cells()
        parser.feed(source or "")
        parser.close()
        parser._end()
        return [dict(zip(names, c)) for c in parser.cells]

    return html.map(one)


@F.pandas_udf(T.BooleanType())
def has_nested_table(html: pd.Series) -> pd.Series:
    def one(source: str | None) -> bool:
        parser = _Cells()
        parser.feed(source or "")
        return parser.nested

    return html.map(one)


def cells_html(cells: Column) -> Column:
    """HTML of an array of cells, ordered by row and column."""
    safe = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    span = lambda c, n: F.when(c[n] > 1, F.concat(F.lit(f' {n}="'), c[n].cast("string"), F.lit('"'))).otherwise("")
    tag = lambda c: F.when(c["is_header"], "th").otherwise("td")
    cell = lambda c: F.concat(F.lit("<"), tag(c), span(c, "rowspan"), span(c, "colspan"), F.lit(">"), safe(c["text"]), F.lit("</"), tag(c), F.lit(">"))
    rows = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["row_index"])))
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.array_sort(F.filter(cells, lambda c: c["row_index"] == r)), cell), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))


def grid(cells: DataFrame) -> DataFrame:
    """table_id, row, column, text: spans spread over the places they cover, the first cell of a place wins."""
    spread = cells.withColumn("row", F.explode(F.sequence("row_index", F.col("row_index") + F.col("rowspan") - 1)))
    spread = spread.withColumn("column", F.explode(F.sequence("column_index", F.col("column_index") + F.col("colspan") - 1)))
    filled = F.when(F.trim("text") != "", F.struct(F.col("row_index"), F.col("column_index"), F.col("text")))
    return spread.groupBy("table_id", "row", "column").agg(F.coalesce(F.min(filled)["text"], F.lit("")).alias("text"))


def grid_lines(cells: DataFrame) -> DataFrame:
    """table_id, markdown: the grid as Markdown; a spanning first row makes two header rows."""
    clean = F.replace(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))
    row = grid(cells).groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("column", clean.alias("text")))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["text"]), " | "), F.lit(" |"))
    lines = row.select("table_id", "row", line.alias("line"), F.size("c").alias("n")).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"), F.max("n").alias("n"))
    wide = cells.groupBy("table_id").agg(F.bool_or((F.col("row_index") == 0) & ((F.col("rowspan") > 1) | (F.col("colspan") > 1))).alias("spans"))
    heads = F.when(F.col("spans") & (F.size("l") > 1), 2).otherwise(1)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n")), " | "), F.lit(" |"))
    texts = F.transform("l", lambda x: x["line"])
    whole = F.concat(F.slice(texts, F.lit(1), heads), F.array(rule), F.slice(texts, heads + 1, F.greatest(F.size("l"), F.lit(1))))
    return lines.join(wide, "table_id").select("table_id", F.array_join(whole, "\n").alias("markdown"))


def reindexed(cells: DataFrame) -> DataFrame:
    """Cells with rows and columns renumbered by the median place of their boxes."""

    def order(index: str, low: str, high: str) -> DataFrame:
        middle = (F.col("bbox")[low] + F.col("bbox")[high]) / 2
        medians = cells.groupBy("table_id", index).agg(F.median(middle).alias("m"))
        return medians.select("table_id", index, (F.row_number().over(Window.partitionBy("table_id").orderBy("m", index)) - 1).alias(f"new_{index}"))

    out = cells.join(order("row_index", "y0", "y1"), ["table_id", "row_index"]).join(order("column_index", "x0", "x1"), ["table_id", "column_index"])
    return out.withColumn("row_index", F.col("new_row_index")).withColumn("column_index", F.col("new_column_index")).drop("new_row_index", "new_column_index")


def bands(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, first, last of runs of consecutive integers: value minus its rank is constant in a run."""
    runs = numbered(values.select(*by, value).distinct(), by, value).withColumn("_run", F.col(value) - F.col("_i"))
    return runs.groupBy(*by, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_run")


def table_regions(cells: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """sheet, row1, column1, row2, column2: bands of used rows, cut into bands of used columns; merged rectangles count as used.

    ``cells``: sheet, row, column with a value. ``merged``: sheet, row1, column1, row2, column2.
    """
    used = cells.select("sheet", "row", "column")
    if merged is not None:
        top = merged.join(cells.select("sheet", F.col("row").alias("row1"), F.col("column").alias("column1")), ["sheet", "row1", "column1"], "left_semi")
        filled = top.withColumn("row", F.explode(F.sequence("row1", "row2"))).withColumn("column", F.explode(F.sequence("column1", "column2")))
        used = used.unionByName(filled.select("sheet", "row", "column")).distinct()
    rows = bands(used, ["sheet"], "row")
    inside = used.join(rows, "sheet").where(F.col("row").between(F.col("first"), F.col("last"))).withColumnRenamed("first", "r1").withColumnRenamed("last", "r2")
    columns = bands(inside, ["sheet", "r1", "r2"], "column")
    boxes = inside.join(columns, ["sheet", "r1", "r2"]).where(F.col("column").between(F.col("first"), F.col("last")))
    return boxes.groupBy("sheet", "r1", "first", "last").agg(F.min("row").alias("row1"), F.max("row").alias("row2")).select("sheet", "row1", F.col("first").alias("column1"), "row2", F.col("last").alias("column2"))


def cell_lines(cells: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """table_id, row_index, column_index, text, confidence of the recognised lines lying in each cell, in reading order."""
    inside = G.coverage(F.col("l.bbox"), F.col("c.bbox")) >= least
    pairs = cells.alias("c").join(lines.alias("l"), (F.col("c.table_id") == F.col("l.table_id")) & inside)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("l.bbox")["y0"], F.col("l.bbox")["x0"], F.col("l.text").alias("t"))))
    return pairs.groupBy(F.col("c.table_id").alias("table_id"), "row_index", "column_index").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"), F.avg("confidence").alias("confidence"))


def in_page_units(boxes: DataFrame) -> DataFrame:
    """Boxes of a table shifted to its block's corner if that puts more of them inside the block. Columns: table_id, bbox, block (box)."""
    b, k = F.col("bbox"), F.col("block")
    moved = G.box(b["x0"] + k["x0"], b["y0"] + k["y0"], b["x1"] + k["x0"], b["y1"] + k["y0"])
    scores = boxes.groupBy("table_id").agg(F.avg(G.coverage(b, k)).alias("_as"), F.avg(G.coverage(moved, k)).alias("_to"))
    return boxes.join(scores, "table_id").withColumn("bbox", F.when(F.col("_to") > F.col("_as"), moved).otherwise(b)).drop("_as", "_to")


#: The names of where a table's text came from.
FROM_TABLE, FROM_PAGE, FROM_HTML, UNMATCHED = "table_ocr_pred", "overall_ocr_res", "pred_html", "_unmatched"


def text_sources(tables: DataFrame, boxes: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """table_id, cell_text_source, html_allowed: whose lines fill a table's cells, and whether its HTML may fill the rest.

    Lines of the table and of the page are compared by how many lie in a cell, then by their mean confidence; the page wins
    a tie. Tables without boxes, or without a line in a cell, take what lines there are. ``boxes``: table_id, cell, bbox.
    ``lines``: table_id, of_page (boolean), bbox, text, confidence. A line beside each box of its own table only is compared.
    """
    places = boxes.groupBy("table_id").agg(F.collect_list("bbox").alias("places"))
    inside = F.exists(F.coalesce("places", F.array().cast(dict(places.dtypes)["places"])), lambda p: G.coverage(F.col("bbox"), p) >= least)
    seen = lines.join(places, "table_id", "left").withColumn("_in", inside)
    score = lambda page: F.struct(F.count_if(F.col("_in") & (F.col("of_page") == page)).alias("n"), F.coalesce(F.avg(F.when(F.col("_in") & (F.col("of_page") == page), F.col("confidence"))), F.lit(0.0)).alias("c"))
    counts = seen.groupBy("table_id").agg(score(False).alias("t"), score(True).alias("p"), F.bool_or(~F.col("of_page")).alias("any_t"), F.bool_or("of_page").alias("any_p"))
    joined = tables.select("table_id").join(counts, "table_id", "left").join(places.select("table_id", F.lit(True).alias("boxed")), "table_id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    wins = has("boxed") & (F.coalesce("p.n", F.lit(0)) > 0) & (F.col("p") >= F.col("t"))
    fits = has("boxed") & (F.coalesce("t.n", F.lit(0)) > 0)
    loose = lambda name: F.when(has("boxed"), name + UNMATCHED).otherwise(name)
    source = (
        F.when(wins, FROM_PAGE).when(fits, FROM_TABLE).when(has("any_t") & (~has("boxed") | ~has("any_p")), loose(FROM_TABLE))
        .when(has("any_p"), loose(FROM_PAGE)).otherwise(FROM_HTML)
    )
    allowed = F.when(wins, F.col("p") == F.col("t")).otherwise(source != FROM_PAGE + UNMATCHED)
    return joined.select("table_id", source.alias("cell_text_source"), allowed.alias("html_allowed"))


def box_cells(boxes: DataFrame) -> DataFrame:
    """Cells of tables known by their boxes alone: a box joins the first row whose first box's middle is near, columns run from left to right."""
    b = F.col("bbox")
    item = F.struct(((b["y0"] + b["y1"]) / 2).cast("double").alias("y"), b["x0"].cast("double").alias("x"), F.col("cell").cast("int").alias("cell"), F.greatest(F.lit(1.0), b["y1"] - b["y0"]).cast("double").alias("h"))
    sorted_boxes = boxes.groupBy("table_id").agg(F.array_sort(F.collect_list(item)).alias("b"))
    none = F.expr("named_struct('heads', cast(array() as array<struct<y:double,h:double>>), 'out', cast(array() as array<struct<row:int,x:double,cell:int>>))")

    def step(acc: Column, k: Column) -> Column:
        near = F.transform(acc["heads"], lambda r: F.abs(k["y"] - r["y"]) <= F.least(k["h"], r["h"]) / 2)
        at = F.array_position(near, F.lit(True)).cast("int")
        row = F.when(at > 0, at - 1).otherwise(F.size(acc["heads"]))
        heads = F.when(at > 0, acc["heads"]).otherwise(F.concat(acc["heads"], F.array(F.struct(k["y"].alias("y"), k["h"].alias("h")))))
        return F.struct(heads.alias("heads"), F.concat(acc["out"], F.array(F.struct(row.alias("row"), k["x"].alias("x"), k["cell"].alias("cell")))).alias("out"))

    rows = sorted_boxes.select("table_id", F.explode(F.aggregate("b", none, step, lambda acc: acc["out"])).alias("r"))
    column = F.row_number().over(Window.partitionBy("table_id", "r.row").orderBy("r.x", "r.cell")) - 1
    return rows.select("table_id", F.col("r.cell").alias("cell"), F.col("r.row").alias("row_index"), column.alias("column_index"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(False).alias("is_header"), F.lit("").alias("text"))


def assembled(tables: DataFrame, boxes: DataFrame, lines: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(cells, tables): cells with their text and confidence, and per table its size, Markdown, HTML, confidence and source.

    ``tables``: table_id, html, confidence (of the block); ``boxes`` and ``lines`` as in ``text_sources``; box k belongs
    to cell k of the HTML. A cell's text is that of the lines in its box, else its HTML text where that is allowed. A
    cell without a confidence takes that of a line with equal text: the nth such cell that of the nth such line. Tables
    with spans or inner tables keep their HTML and have no Markdown; the others are renumbered by place if all cells
    have boxes. Write the three inputs first if they cost much: each is read several times.
    """
    sources = text_sources(tables, boxes, lines, least)
    named = tables.select("table_id", F.posexplode(html_cells("html")).alias("cell", "c")).select("table_id", "cell", "c.*")
    bare = boxes.join(named.select("table_id").distinct(), "table_id", "left_anti")
    cells = named.unionByName(box_cells(bare)).join(boxes.select("table_id", "cell", "bbox"), ["table_id", "cell"], "left").join(sources, "table_id")
    wanted = F.when(F.col("cell_text_source").startswith(FROM_PAGE), True).when(F.col("cell_text_source").startswith(FROM_TABLE), False)
    chosen = lines.join(sources.select("table_id", wanted.alias("_w")), "table_id").where("of_page = _w").withColumn("text", F.trim("text"))
    # Cells keep their number through the join, so that two cells at one place keep their own text.
    filled = cell_lines(cells.where("bbox is not null").select("table_id", F.col("cell").alias("row_index"), F.lit(0).alias("column_index"), "bbox"), chosen, least)
    filled = filled.select("table_id", F.col("row_index").alias("cell"), F.col("text").alias("_read"), F.col("confidence").alias("_sure"))
    cells = cells.join(filled, ["table_id", "cell"], "left")
    key = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), r"(?U)\s+", " "))
    nth = lambda order: F.row_number().over(Window.partitionBy("table_id", "_k").orderBy(*order))
    open_cells = cells.where("_sure is null and text != ''").select("table_id", "cell", key("text").alias("_k")).withColumn("_n", nth(["cell"]))
    said = chosen.select("table_id", key("text").alias("_k"), "bbox", "confidence").withColumn("_n", nth([F.col("bbox")["y0"], F.col("bbox")["x0"]]))
    equal = open_cells.join(said, ["table_id", "_k", "_n"]).select("table_id", "cell", F.col("confidence").alias("_equal"))
    text = F.coalesce(F.when(F.col("_read") != "", F.col("_read")), F.when(F.col("html_allowed"), F.col("text")), F.lit(""))
    cells = cells.join(equal, ["table_id", "cell"], "left").withColumns({"text": text, "confidence": F.coalesce("_sure", "_equal")}).drop("_read", "_sure", "_equal")
    each = cells.groupBy("table_id").agg(F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("has_merged_cells"), F.bool_and(F.col("bbox").isNotNull()).alias("_boxed"))
    inner = tables.select("table_id", has_nested_table("html").alias("has_nested_table"))
    shape = each.join(inner, "table_id").withColumn("_simple", ~F.col("has_merged_cells") & ~F.col("has_nested_table"))
    cells = cells.join(shape.select("table_id", "_simple", "_boxed"), "table_id")
    cells = reindexed(cells.where("_simple and _boxed")).unionByName(cells.where("not (_simple and _boxed)")).drop("_boxed")
    simple = cells.where("_simple")
    row = F.array_sort(F.collect_list(F.struct("row_index", "column_index", "rowspan", "colspan", "is_header", "text")))
    made = cells.groupBy("table_id").agg(row.alias("_c"), F.avg("confidence").alias("_mean"), F.max(F.col("row_index") + F.col("rowspan")).alias("rows"), F.max(F.col("column_index") + F.col("colspan")).alias("columns"))
    made = made.join(grid_lines(simple), "table_id", "left").join(shape.drop("_boxed"), "table_id")
    out = tables.join(made, "table_id", "left").join(sources, "table_id").select(
        "table_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("columns", F.lit(0)).alias("columns"), F.coalesce("markdown", F.lit("")).alias("markdown"),
        F.when(F.col("_simple") | (F.coalesce("html", F.lit("")) == ""), F.coalesce(cells_html(F.col("_c")), "html")).otherwise(F.col("html")).alias("html"),
        F.coalesce("_mean", "confidence").alias("confidence"), F.coalesce("has_merged_cells", F.lit(False)).alias("has_merged_cells"), F.coalesce("has_nested_table", F.lit(False)).alias("has_nested_table"), "cell_text_source", "html_allowed",
    )
    return cells.drop("_simple", "html_allowed", "cell_text_source"), out


def matched_tables(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """page_id, block_id, result_id, how: by id, then one to one by largest IoU, then by position."""

    def match(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("block_id"), right.sort_values("result_id")
        free_l, free_r, out = dict(zip(left["block_id"], left["bbox"])), dict(zip(right["result_id"], right["bbox"])), []

        def take(b, r, how):
            out.append((key[0], b, r, how))
            free_l.pop(b), free_r.pop(r)

        named = dict(zip(right["result_id"], right["for_block"]))
        for r, b in named.items():
            if b in free_l and r in free_r:
                take(b, r, "id")

        def overlap(a, b) -> float:
            both = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
            area = lambda q: max(0.0, q["x1"] - q["x0"]) * max(0.0, q["y1"] - q["y0"])
            return both / (area(a) + area(b) - both) if both else 0.0

        ranked = sorted(((overlap(lb, rb), -b, -r) for b, lb in free_l.items() for r, rb in free_r.items()), reverse=True)
        for value, b, r in ranked:
            if value > 0 and -b in free_l and -r in free_r:
                take(-b, -r, "overlap")
        for b, r in list(zip(list(free_l), list(free_r))):
            take(b, r, "position")
        return pd.DataFrame(out, columns=["page_id", "block_id", "result_id", "how"])

    return blocks.select("page_id", "block_id", "bbox").groupBy("page_id").cogroup(results.select("page_id", "result_id", "for_block", "bbox").groupBy("page_id")).applyInPandas(match, "page_id long, block_id long, result_id long, how string")
