"""Workbook sheets, pictures, table assembly, remote calls, generation smoke queries and manifests."""

import io
import json
import random
import zipfile

import duckdb
import pandas as pd
import pytest

from tessera.functions import ranks
from tessera.operators import dedup, images, index, remote, sessions, tables
from tessera.plans import catalog
from tessera.sources import files

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="A" r:id="r1"/><sheet name="B" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{_S}"><cols><col min="27" max="28" hidden="1"/></cols><sheetData><row r="3" hidden="1"/><row r="4"/></sheetData><mergeCells><mergeCell ref="B2:AB4"/><mergeCell ref="A1"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{_S}"><sheetData/></worksheet>')
    return out.getvalue()


def test_sheets_and_merged_ranges(spark):
    found = files.sheets(spark.createDataFrame([("/x/book.xlsx", workbook())], "path string, content binary"))
    a, b = found.orderBy("sheet").collect()
    assert (a.state, a.hidden_rows, a.hidden_columns, b.state, b.merged_cells) == ("visible", [3], ["AA", "AB"], "hidden", [])
    ranges = files.merged_ranges(found).drop("document_id", "sheet").collect()
    assert sorted(map(tuple, ranges)) == [(1, 1, 1, 1), (2, 2, 4, 28)]


def test_pictures_are_elements_and_others_fail(spark):
    rows = spark.createDataFrame([("a.png", b"\x89PNG\r\n\x1a\n.."), ("b.jpg", b"no picture")], "path string, content binary")
    read = lambda raw: files.image_elements(raw, lambda _: iter([("paragraph", "seen", None)]))
    got = files.parse(rows, {"image": read}).orderBy("path", "position").collect()
    assert [(r.path, r.element_type, r.text, r.status) for r in got] == [("a.png", "image", "", "ok"), ("a.png", "paragraph", "seen", "ok"), ("b.jpg", "unknown", "", "failed")]
    assert files.parse(rows.where("path = 'a.png'")).count() == 1


def lines(spark, rows):
    return spark.createDataFrame(rows, f"table_id int, of_page boolean, bbox {BOX}, text string, confidence double")


def test_table_from_html_boxes_and_lines(spark):
    simple = "<table><tr><td>x</td><td>y</td></tr><tr><td>z</td><td></td></tr></table>"
    t = spark.createDataFrame([(1, simple, 0.5), (2, "<table><tr><td colspan=2>m</td></tr></table>", 0.4), (3, None, 0.3), (4, simple, None)], "table_id int, html string, confidence double")
    cell = lambda k, row, column: (k, (10.0 * column, 10.0 * row, 10.0 * column + 9, 10.0 * row + 9))
    # Rows of table 1 come upside down; table 3 has boxes only; table 4 has neither boxes nor lines.
    b1 = [(1, *cell(k, row, column)) for k, (row, column) in enumerate([(1, 0), (1, 1), (0, 0), (0, 1)])]
    b3 = [(3, *cell(k, row, column)) for k, (row, column) in enumerate([(1, 1), (0, 0), (0, 1), (1, 0)])]
    boxes = spark.createDataFrame(b1 + b3, f"table_id int, cell int, bbox {BOX}")
    said = [(1, False, (0.0, 10.0, 5.0, 15.0), "X!", 0.9), (1, False, (0.0, 0.0, 5.0, 5.0), "Z!", 0.7), (1, True, (0.0, 10.0, 5.0, 15.0), "far", 0.2), (3, True, (10.0, 10.0, 18.0, 18.0), "d", 0.8), (3, True, (90.0, 90.0, 95.0, 95.0), "out", 0.1)]
    cells, done = tables.assembled(t, boxes, lines(spark, said))
    got = {r.table_id: r for r in done.collect()}
    assert got[1].cell_text_source == "table_ocr_pred" and got[1].markdown.splitlines() == ["| Z! |  |", "| --- | --- |", "| X! | y |"]
    assert got[1].confidence == pytest.approx(0.8) and got[1].html.startswith("<table><tr><td>Z!")
    assert (got[2].markdown, got[2].has_merged_cells, got[2].cell_text_source, got[2].confidence) == ("", True, "pred_html", 0.4)
    assert (got[3].rows, got[3].columns, got[3].cell_text_source, got[3].html_allowed) == (2, 2, "overall_ocr_res", False)
    assert got[3].markdown.splitlines()[-1] == "|  | d |" and got[4].markdown.splitlines()[0] == "| x | y |"
    assert cells.where("table_id = 1").count() == 4


def test_text_sources_rank_by_count_then_confidence(spark):
    t = spark.createDataFrame([(k, "", None) for k in range(1, 6)], "table_id int, html string, confidence double")
    at, off = (0.0, 0.0, 4.0, 4.0), (50.0, 50.0, 54.0, 54.0)
    boxes = spark.createDataFrame([(k, 0, (0.0, 0.0, 9.0, 9.0)) for k in (1, 2, 3, 4)], f"table_id int, cell int, bbox {BOX}")
    said = [(1, False, at, "a", 0.5), (1, True, at, "b", 0.5), (2, False, at, "a", 0.6), (2, True, at, "b", 0.5), (3, False, off, "a", 0.9), (3, True, off, "b", 0.9), (4, False, off, "a", 0.9), (5, True, at, "b", 0.9)]
    got = {r.table_id: (r.cell_text_source, r.html_allowed) for r in tables.text_sources(t, boxes, lines(spark, said)).collect()}
    assert got == {1: ("overall_ocr_res", True), 2: ("table_ocr_pred", True), 3: ("overall_ocr_res_unmatched", False), 4: ("table_ocr_pred_unmatched", True), 5: ("overall_ocr_res", True)}


def test_caption_fields_keep_errors_as_rows(spark):
    rows = spark.createDataFrame([(1, '{"title": "t"}'), (2, "no json"), (3, '{"other": 1}'), (4, None)], "k int, a string")
    got = {r.k: (r.f.caption, r.f.error) for r in rows.select("k", images.caption_fields(rows.a, "title string", ["title"]).alias("f")).collect()}
    assert got[1][0].title == "t" and [got[k][1] for k in (1, 2, 3, 4)] == [None, "not valid JSON", "missing: title", "not valid JSON"]


def test_calls_are_batched_paced_and_repeated():
    now, slept, asked = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    def model(batch):
        asked.append(len(batch))
        if len(asked) == 2:
            raise remote.Retryable("busy", after="7")
        return batch.str.upper()

    pacer = remote.Pacer(4.0, lambda: now[0], sleep)
    got = remote.polite(model, size=2, pacer=pacer, sleep=sleep)(pd.Series(list("abc"), index=[5, 6, 7]))
    assert got.to_dict() == {5: "A", 6: "B", 7: "C"} and asked == [2, 1, 1] and slept == [4.0, 7.0]
    assert remote.polite(model, pacer=pacer, sleep=sleep)(pd.Series([], dtype=object)).empty
    assert remote.pause(3, draw=lambda: 0.0) == 8.0 and remote.pause(0, "x", draw=lambda: 1.0) == 1.25 and remote.pause(9, "0") == 0.0
    with pytest.raises(remote.Retryable):
        remote.polite(lambda b: (_ for _ in ()).throw(remote.Retryable()), attempts=2, pacer=pacer, sleep=sleep)(pd.Series(["a"]))
    with pytest.raises(ValueError):
        remote.polite(lambda b: [], pacer=pacer, sleep=sleep)(pd.Series(["a"]))


def test_secret_prefers_the_environment(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nexport A='1'\nB=2=3\n")
    monkeypatch.setenv("B", "env")
    assert [remote.secret(n, str(tmp_path / ".env")) for n in "ABC"] == ["1", "env", None]
    assert remote.secret("A", None) is None


def test_smoke_queries_and_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, "text", "red apple"), ("b", 1, "text", "green pear")], "chunk_id string, doc_id int, type string, content string")
    home = index.build(chunks, str(tmp_path), "g1")
    assert index.smoke(spark, home, "green apple").first()["ok"]
    assert index.smoke(spark, home, "zebra").first()["errors"] == ["sparse_smoke_empty"]
    row = index.manifest(spark, str(tmp_path / "manifest.json"), "r1", "2026-01-01T00:00:00", chunks, chunks.limit(1), 1, True, backend="files")
    assert json.loads((tmp_path / "manifest.json").read_text()) == row
    assert (row["chunks_skipped_dup"], row["status"], row["backend"]) == (1, "published", "files")


def test_upsert_local_by_hash_and_key(spark):
    schema = "seq int, chunk_id string, content_hash string"
    store = spark.createDataFrame([(1, "a", "h1"), (2, "b", "")], schema)
    new = spark.createDataFrame([(1, "c", "h1"), (3, "b", "h2"), (4, "d", "h2"), (5, "e", ""), (6, "f", None)], schema)
    assert sorted((r.chunk_id, r.seq) for r in dedup.upsert_local(store, new).collect()) == [("a", 1), ("b", 3), ("e", 5), ("f", 6)]


def test_numbers_run_through_buckets_and_null_keys(spark):
    r = random.Random(1)
    data = [(k, o) for k in ("a", "b", None) for o in r.sample(range(-200_000, 400_000), 40)] + [("c", None), ("c", 5)]
    got = ranks.numbered(spark.createDataFrame(data, "k string, o long"), ["k"], "o").collect()
    for key in ("a", "b", None, "c"):
        mine = sorted((x for x in got if x.k == key), key=lambda x: x["_i"])
        assert [x["_i"] for x in mine] == list(range(1, len(mine) + 1)) and {x["_n"] for x in mine} == {len(mine)}
        assert [x.o for x in mine] == sorted((o for k, o in data if k == key), key=lambda o: (o is not None, o or 0))


def test_session_memory_on_long_conversations(spark):
    r = random.Random(3)
    size = lambda: r.choice([0, 3, 50, 400, 900, 1900, 2000, 2001, 3000])
    told = pd.DataFrame([(c, t, r.choice(["user", "assistant"]), "".join(r.choice("ab é\n") for _ in range(size()))) for c in range(60) for t in range(r.randint(1, 25))], columns=["conv_id", "turn", "role", "text"])
    got = sessions.session_memory(spark.createDataFrame(told), max_chars=2000).drop("turns").toPandas()
    con = duckdb.connect()
    con.register("conversations", told)
    want = con.execute(catalog.oracle_sql()["session_memory"]).df()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want[got.columns].to_numpy().tolist()))
