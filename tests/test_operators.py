import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import answer, chunking, correction, dedup, dense, elements, evaluate, hybrid, images, index, layout, lexical, sessions, tables, telemetry
from tessera.sources import files, html

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(*v):
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, v)))


def test_rank_fusion_order(spark):
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "question_id int, chunk_id string, rank int") for x in (["a", "b"], ["b", "c"])]
    rows = hybrid.fuse(lists).orderBy(F.col("fused").desc(), "place").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "a", "c"]


CANDIDATES = "question_id int, chunk_id string, fused double, place struct<list:int,rank:int>, dense double, content string, file_name string, page int"


def gated(spark, rows, threshold, question="q", **kw):
    q = spark.createDataFrame([(1, question)], "question_id int, question string")
    kept, out = hybrid.gate(q, spark.createDataFrame(rows, CANDIDATES), threshold, **kw)
    return [r["chunk_id"] for r in kept.orderBy("rank").collect()], out.first()


def test_gate(spark):
    rows = [(1, f"c{i}", 1.0 - i / 100, (0, i), d, t, "f", 1) for i, (d, t) in enumerate([(0.9, "x"), (float("nan"), "x"), (0.4, "x"), (0.8, " "), (0.7, "y"), (None, "x")])]
    assert gated(spark, rows, 0.5) == (["c0", "c4"], (1, False, "", 0.9))
    assert gated(spark, rows, None)[1][1:3] == (True, "relevance threshold not configured")
    assert gated(spark, rows, 0.95) == ([], (1, True, "below relevance threshold", 0.9))
    assert gated(spark, [], 0.5)[1][1:3] == (True, "no matching chunks")
    assert gated(spark, rows, 0.5, question="  ")[1]["reason"] == "empty query"
    assert gated(spark, rows, 0.5, top_k=1, pool=1)[0] == ["c0"]


def test_thresholds():
    assert hybrid.resolve_threshold(None, None) is None and hybrid.resolve_threshold(0.4, None) == 0.4 and hybrid.resolve_threshold(0.4, 0.6) == 0.6
    with pytest.raises(ValueError):
        hybrid.resolve_threshold(2, None)


def test_retrieval_from_a_published_index(spark, tmp_path):
    root, n = f"file://{tmp_path}", 60
    texts = [f"chunk number {i} about topic{i % 5} and word{i % 7}" for i in range(n)]
    chunks = spark.createDataFrame([(f"c{i:02d}", i % 3, "table" if i % 2 else "text", t, "f.pdf", 1) for i, t in enumerate(texts)], "chunk_id string, doc_id long, type string, content string, file_name string, page int")
    made = index.published(spark, root, "g1", chunks)
    assert index.published(spark, root, "g1", chunks.limit(0)).payload.count() == n  # it is current, so nothing is built again
    q = spark.createDataFrame([(1, "number 7 about topic2"), (2, "nothing of it")], "question_id int, question string")
    asked = V.dense_hash(q, "question_id", "question")
    words = lexical.scores_from_index(q, made.postings, made.lengths)
    plain = {(r["question_id"], r["chunk_id"]): r["bm25"] for r in lexical.scores(q, chunks, key="chunk_id", text="content").collect()}
    assert {(r["question_id"], r["chunk_id"]): pytest.approx(r["bm25"]) for r in words.collect()} == plain
    run = lambda **kw: [(r["chunk_id"], r["type"]) for r in hybrid.retrieve(q, asked, made.payload, made.vectors, words, 0.1, **kw)[0].where("question_id = 1").orderBy("rank").collect()]
    assert run()[0] == ("c07", "table") and len(run(top_k=3)) == 3
    # The filter holds before either list is cut, so the wanted rows still fill the answer.
    kept = run(wanted=dense.payload_filter(type="text"), dense_top=5, sparse_top=5)
    assert len(kept) == 5 and all(t == "text" for _, t in kept)
    assert run(scorer=F.when(F.col("chunk_id") == "c22", 2.0).otherwise(F.length("question") / 1000), top_k=9)[0][0] == "c22"
    # An id without payload takes part in fusion and is dropped by the gate.
    assert ("c07", "table") not in [x for x in run() if x[0] != "c07"] and run() and "c07" not in [x for x, _ in [(r["chunk_id"], 0) for r in hybrid.retrieve(q, asked, made.payload.where("chunk_id <> 'c07'"), made.vectors, words, 0.1)[0].collect()]]


def test_questions_contained_in_texts(spark):
    texts = spark.createDataFrame([("a", "One two, three four five."), ("b", "xone two threex"), ("c", "Hi")], "chunk_id string, content string")
    q = ["two, three", "ne two, three fou", "one two three", "One two three", "two", "Hi", "zzz", "three four five six", "two three"]
    asked = spark.createDataFrame(list(enumerate(q)), "question_id int, question string")
    got = {r[0] for r in lexical.containing(asked, lexical.postings(texts, "chunk_id", "content"), texts).collect()}
    assert got == {i for i, x in enumerate(q) if any(x in t for t in ("One two, three four five.", "xone two threex", "Hi"))}


def test_reranker_must_be_finite(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),)], "s double")
    with pytest.raises(Exception, match="finite"):
        hybrid.reranked(rows, F.col("s")).collect()


def test_answers(spark):
    q = spark.createDataFrame([(1, "what?"), (2, "other?"), (3, "")], "question_id int, question string")
    kept = spark.createDataFrame([(1, 1, "f.pdf", 2, "the passage\nmore"), (1, 2, "f.pdf", 2, "x")], "question_id int, rank int, file_name string, page int, content string")
    out = spark.createDataFrame([(1, False, "", 0.9), (2, True, "below relevance threshold", 0.1), (3, True, "empty query", 0.0)], "question_id int, fallback boolean, reason string, best_score double")
    got = {r["question_id"]: r for r in answer.answers(q, kept, out).collect()}
    assert got[1]["answer"] == "the passage\n\nNguồn: [f.pdf, trang 2]" and not got[1]["fallback"]
    assert got[2]["answer"] == hybrid.FALLBACK and got[2]["reason"] == "below relevance threshold" and got[3]["reason"] == "empty question"


ROWS = "chunk_id string, seq long, content_hash string"


def test_three_upserts_differ(spark):
    store = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "h2")], ROWS)
    new = spark.createDataFrame([("c", 3, "h1"), ("d", 4, "h4"), ("e", 5, "h4"), ("b", 6, "h6"), ("f", 7, ""), ("g", 8, "")], ROWS)
    ids = lambda df: sorted((r["chunk_id"], r["content_hash"]) for r in df.collect())
    assert ids(dedup.upsert_local(store, new)) == [("a", "h1"), ("b", "h6"), ("d", "h4"), ("f", ""), ("g", "")]
    assert ids(dedup.upsert_dense(store, new)) == [("a", "h1"), ("b", "h6"), ("d", "h4"), ("e", "h4"), ("f", ""), ("g", "")]
    assert ids(dedup.upsert_hybrid(store, new)) == [("a", "h1"), ("b", "h6"), ("c", "h1"), ("d", "h4"), ("e", "h4"), ("f", ""), ("g", "")]


def test_chunk_identity(spark):
    import hashlib
    import json

    want = "d-text-" + hashlib.sha256(json.dumps(["d", "text", 0, ["e1", "e2"], hashlib.sha256(b"x").hexdigest()], separators=(",", ":")).encode()).hexdigest()[:20]
    assert spark.range(1).select(dedup.chunk_id(F.lit("d"), F.lit("text"), F.lit(0), F.array(F.lit("e1"), F.lit("e2")), F.lit("x"))).first()[0] == want
    assert chunking._row("d", "text", 0, "x", "x", [{"source_element_ids": ["e1", "e2"], "page_number": None, "section_id": None, "heading_path": []}], str.split)["chunk_id"] == want


def element(i, kind, text, path=(), page=None):
    return {"element_id": f"e{i}", "order": i, "element_type": kind, "text": text, "heading_path": list(path), "page_number": page, "section_id": None, "source_element_ids": [f"e{i}"], "text_for_embedding": text}


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_long_text_is_cut_with_overlap_and_nothing_is_lost():
    out = chunking.type_aware("d", [element(0, "paragraph", words(1250))])
    assert len(out) == 3 and all(c["n_tokens"] <= 600 for c in out)
    got = out[0]["content"].split()
    for c in out[1:]:
        tokens = c["content"].split()
        assert tokens[:50] == got[-50:]
        got += tokens[50:]
    assert got == words(1250).split()


def test_sections_do_not_mix_and_headings_prefix():
    out = chunking.type_aware("d", [element(0, "heading", "A", ["A"]), element(1, "paragraph", words(450, "a"), ["A"]), element(2, "paragraph", words(450, "b"), ["B"])])
    assert len(out) == 2 and out[0]["text_for_embedding"].startswith("A\n\na0") and not set(out[0]["content"].split()) & set(out[1]["content"].split())
    assert chunking.type_aware("d", [element(0, "heading", "Alone", ["Alone"])])[0]["content"] == "Alone"


def test_tables_keep_rows_whole_under_their_header():
    text = "\n".join(["| h |", "| --- |", *[f"| {words(10, f'r{i}-')} |" for i in range(300)]])
    out = chunking.type_aware("d", [element(0, "table", text, ["T"])])
    assert len(out) > 4 and all(c["content"].startswith("| h |\n| --- |\n") and c["n_tokens"] <= 768 for c in out)
    assert sum(len(c["content"].split("\n")) - 2 for c in out) == 300
    with pytest.raises(ValueError, match="exceeds"):
        chunking.type_aware("d", [element(0, "table", f"| h |\n| --- |\n| {words(800)} |")])


def test_budgets_are_checked():
    with pytest.raises(ValueError):
        chunking.Budget(target=700)


def test_plain_chunks():
    out = chunking.by_characters("d", [element(0, "heading", "Intro"), element(1, "paragraph", "x" * 1500), element(2, "paragraph", "y" * 900), element(3, "table", "| a |", page=12), element(4, "image", "", page=13)])
    assert [c["type"] for c in out] == ["text", "text", "table", "figure"] and [c["chunk_id"] for c in out][0] == "d-c0001"
    assert out[1]["content"].startswith("x" * 200 + "\n\n") and out[2]["content"] == "[intro]\n| a |" and out[3]["content"].startswith("[FIGURE")


def test_heading_paths():
    kinds = ["heading"] * 6
    texts = ["CHƯƠNG I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "Điều 2. Khác", "Plain", "Deep"]
    assert elements.retrieval_headings([None] * 5 + [2], kinds, texts) == [["CHƯƠNG I"], ["CHƯƠNG I", "QUY ĐỊNH CHUNG"], ["CHƯƠNG I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi"], ["CHƯƠNG I", "QUY ĐỊNH CHUNG", "Điều 2. Khác"], ["Plain"], ["Plain", "Deep"]]
    assert elements.context_headings([1, 2, 2, None], ["heading"] * 3 + ["paragraph"], ["A", "B", "C", "t"]) == [["A"], ["A", "B"], ["A", "C"], ["A", "C"]]


def test_numbering_does_not_cascade_and_needs_agreeing_readings(spark):
    heads = ["Điều 1. a", "Điều 2. b", "Điều 8. c", "Điều 4. d", "CHƯƠNG I", "CHƯƠNG III x"]
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate(heads)], "document_id long, order int, text string")
    issues = elements.numbering_review(rows)
    assert sorted((r["order"], r["suggested"]) for r in issues.collect()) == [(2, "3"), (5, "II")]
    readings = spark.createDataFrame([(1, 2, 1.5, "Điều 3. c", 0.9), (1, 2, 2.0, "Điều 3. c", 0.85), (1, 5, 1.5, "CHƯƠNG II", 0.9), (1, 5, 2.0, "CHƯƠNG II", 0.5)], "document_id long, order int, scale double, reading string, confidence double")
    assert {r["order"]: r["status"] for r in elements.confirmed_numbers(issues, readings).collect()} == {2: "corrected_by_crop_ocr", 5: "needs_review"}


@pytest.mark.parametrize("text,images_n,cover,kind", [("", 0, 0.0, "digital"), ("", 1, 0.9, "scanned"), ("word " * 50, 1, 0.1, "hybrid"), ("word " * 50, 0, 0.0, "digital"), ("Title", 0, 0.0, "digital"), ("Title", 1, 0.8, "scanned")])
def test_page_types(spark, text, images_n, cover, kind):
    c = elements.page_type(F.lit(text), F.lit(1), F.lit(images_n), F.lit(cover), F.lit(500000.0))
    assert spark.range(1).select(c["page_type"]).first()[0] == kind


def test_quality_report_and_contract(spark):
    rows = spark.createDataFrame([(1, "a", None, "paragraph", "good text", 1), (1, "a", "zz", "paragraph", "\x01\x02\x03", 9), (2, "i", None, "image", "x", 1)], "document_id long, element_id string, parent_id string, element_type string, text string, page_number int")
    pages = spark.createDataFrame([(1, 1, "ok"), (1, 2, "failed"), (2, 1, "ok"), (3, 1, "ok")], "document_id long, page_number int, status string")
    got = {r["document_id"]: r for r in elements.quality_report(rows, pages).collect()}
    assert got[1]["warnings"] == ["Invalid character ratio exceeds threshold", "Pages failed: [2]"] and got[1]["text_length"] == 13
    assert got[2]["warnings"] == ["No text extracted; inspect image assets or blank pages"] and len(got[3]["warnings"]) == 2
    broken = {(r["rule"], r["value"]) for r in elements.contract_violations(rows, pages).collect()}
    assert broken == {("duplicate element id", "a"), ("unknown parent", "zz"), ("unknown page", "a")}


def test_retrieval_elements_and_captions(spark):
    rows = spark.createDataFrame([(1, "e1", 0, "heading", "Title"), (1, "e2", 1, "footer", "3"), (1, "e3", 2, "image", ""), (1, "e4", 3, "image", ""), (1, "e5", 4, "paragraph", "body")], "document_id long, element_id string, order int, element_type string, text string")
    captions = spark.createDataFrame([("e3", 1, "completed", True, "a chart"), ("e4", 1, "error", True, "no")], "element_id string, document_id long, status string, retrieval_useful boolean, display string")
    got = [(r["element_id"], r["text_for_embedding"]) for r in elements.retrieval_elements(rows, captions).orderBy("order").collect()]
    assert got == [("e1", "Title"), ("e3", "Title\na chart"), ("e5", "Title\nbody")]
    with pytest.raises(Exception, match="mismatch"):
        elements.retrieval_elements(rows, captions.withColumn("document_id", F.lit(9).cast("long"))).collect()


@pytest.mark.parametrize("b,a,want", [(150, 150, (100, 100)), (30, 200, (30, 170)), (250, 0, (200, 0)), (12, 17, (12, 17))])
def test_image_context_quota(spark, b, a, want):
    assert images.allocated(b, a) == want
    rows = spark.createDataFrame([(1, "x", 0, "paragraph", words(b, "b")), (1, "i", 1, "image", ""), (1, "y", 2, "paragraph", words(a, "a"))], "document_id long, element_id string, order int, element_type string, text string")
    r = images.contexts(rows).first()
    assert (r["n_before"], r["n_after"]) == want
    assert r["before"] == " ".join(words(b, "b").split()[b - want[0] :]) and r["after"] == " ".join(words(a, "a").split()[: want[1]])


def test_caption_review(spark):
    schema = "title string, caption string, visible_text array<string>, uncertainties array<string>, steps array<string>, relationships array<string>, chart_details string, image_type string, retrieval_useful boolean, contextual_relevance string"
    rows = [("t", "lorem ipsum", [], [], [], [], "", "chart", True, None), ("", "", ["annual revenue table"], [], [], [], "", "logo", True, None), ("", "", [], [], [], [], "", "flowchart", False, "near"), ("ok", "fine", ["x"], [], [], [], "", "photo", True, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(images.review_reasons(F.lit("the Annual  revenue table of 2020"))).collect()]
    assert got[0] == ["placeholder_or_non_description", "chart_missing_details_or_uncertainty"] and got[3] == []
    assert got[1] == ["decorative_type_marked_retrieval_useful", "visible_text_matches_context_without_uncertainty"]
    assert got[2] == ["flowchart_missing_structure", "context_only_without_visual_description"]


def test_correction_chain(spark):
    schema = "element_type string, text string, parser string, ocr_confidence double, flagged array<string>, excluded boolean"
    rows = [("paragraph", "mọi ngưười đều biết", "paddleocr", 0.9, None, False), ("paragraph", "văn bản sạch", "paddleocr", 0.5, None, False), ("paragraph", "ngưười", "docling", 0.9, None, False), ("table", "ngưười", "paddleocr", 0.9, None, False)]
    got = {r["text_original"] or r["text"]: r for r in correction.corrected(spark.createDataFrame(rows, schema)).collect()}
    assert got["mọi ngưười đều biết"]["status"] == "accepted" and got["mọi ngưười đều biết"]["text"] == "mọi người đều biết"
    assert got["văn bản sạch"]["status"] is None and len(got) == 3


def test_detection_reasons(spark):
    rows = [("Ngưười dân , duùng", 0.5, ["x"]), ("sạch sẽ", 0.5, None), ("sạch!!", None, None), ("  ", 0.1, ["x"]), (None, None, None), ("naïive", 0.99, [])]
    frame = spark.createDataFrame(rows, "text string, c double, f array<string>")
    got = [r["d"] for r in frame.select(correction.detect(F.col("text"), F.col("c"), F.col("f")).alias("d")).collect()]
    assert got[0]["reasons"] == ["low_ocr_confidence", "ocr_review_spelling_flag", "known_vietnamese_ocr_pattern", "repeated_base_character", "punctuation_anomaly"]
    assert got[0]["tokens"] == ["x", "Ngưười", "duùng"] and got[0]["options"]["duùng"] == ["dùng", "dung"] and got[0]["options"]["ngưười"] == ["người", "Người", "Ngưòi"][:1] + got[0]["options"]["ngưười"][1:]
    assert (got[1]["should_correct"], got[1]["reasons"]) == (False, ["low_ocr_confidence"]) and got[2]["reasons"] == ["punctuation_anomaly"] and got[2]["should_correct"]
    assert not got[3]["should_correct"] and not got[4]["should_correct"] and got[3]["reasons"] == got[4]["reasons"] == []
    assert got[5]["options"] == {"naïive": ["naive", "naïve"]}


def test_a_second_correction_keeps_the_first_original(spark):
    schema = "element_type string, text string, parser string, ocr_confidence double, flagged array<string>, excluded boolean"
    rows = spark.createDataFrame([("paragraph", "mọi ngưười đều biết phuục vụ cho mọi việc", "paddleocr", 0.9, None, False)], schema)
    half = lambda wrong, right: lambda t: t.str.replace(wrong, right)
    first = correction.corrected(rows, half("ngưười", "người"), most=3)
    again = first.drop("status", "reason", "candidate", "edit_ratio")
    again = spark.createDataFrame(again.collect(), again.schema)  # as from a written table
    got = correction.corrected(again, half("phuục", "phục")).first()
    assert got["text"] == "mọi người đều biết phục vụ cho mọi việc" and got["text_original"] == rows.first()["text"]
    assert [(c["before"], c["after"]) for c in got["changes"]] == [(rows.first()["text"], first.first()["text"]), (first.first()["text"], got["text"])]
    off = correction.corrected(rows, enabled=False).first()
    assert (off["status"], off["text"], off["changes"]) == ("disabled", rows.first()["text"], None)


def test_edits_stay_local():
    ok = correction.edits_are_local
    assert ok("a ngưười b", "a người b", ["ngưười"], {"ngưười": ["người"]}, False)
    assert not ok("a b", "a c", [], {}, False) and not ok("x y", "x z", ["y"], {"y": ["w"]}, False)
    assert not ok("a b", "a b c", ["c"], {}, False) and not ok("a b", "a , b", [], {}, False) and ok("a b", "a , b", [], {}, True)


@pytest.mark.parametrize("a,b,same", [("gọi 12.5% ngay", "gọi 12.5% ngày", True), ("số 12", "số 13", False), ("mail a@b.vn", "mail a@c.vn", False), ("ngày 1 tháng 2 năm 2020", "ngày 1 tháng 3 năm 2020", False)])
def test_protected_tokens(spark, a, b, same):
    assert spark.range(1).select(correction.protected_tokens(F.lit(a)) == correction.protected_tokens(F.lit(b))).first()[0] is same


def test_segments_join_to_the_text():
    text = "Điều 1. Nội dung thứ nhất. Câu hai; câu ba!\nDòng mới không chấm câu nào cả\n\nHết."
    for most in (3, 5, 9, 100):
        for by in (False, True):
            parts = correction.segments(text, most, lambda t: len(t.split()), by)
            assert "".join(parts) == text and all(len(p.split()) <= most for p in parts)
    with pytest.raises(ValueError):
        correction.segments("abc def", 0, lambda t: len(t.split()))


def test_spelling(spark):
    w = spark.createDataFrame([("nêền",), ("nền",), ("abc",)], "word string")
    v = spark.createDataFrame([("nền",), ("abc",)], "term string")
    assert [(r["word"], r["suggestions"]) for r in correction.spelling_suggestions(w, v).collect()] == [("nêền", ["nền"])]


def test_page_layout(spark):
    schema = f"page_id long, block_id long, element_type string, text string, bbox {BOX}, width double, height double"
    two = [(1, 1, "text", "left", box(0, 50, 250, 400), 600.0, 800.0), (1, 2, "text", "right", box(320, 0, 590, 400), 600.0, 800.0)]
    one = [(2, 1, "text", "below", box(0, 100, 300, 200), 600.0, 800.0), (2, 2, "text", "above", box(0, 0, 300, 50), 600.0, 800.0), (2, 3, "text", "12", box(290, 780, 310, 795), 600.0, 800.0)]
    blocks = spark.createDataFrame(two + one, schema)
    order = {(r["page_id"], r["block_id"]): r["order"] for r in layout.reading_order(blocks).collect()}
    assert order == {(1, 1): 0, (1, 2): 1, (2, 2): 0, (2, 1): 1, (2, 3): 2}
    assert [r["block_id"] for r in layout.page_numbers_retyped(blocks).where("excluded").collect()] == [3]
    dup = layout.without_duplicates(spark.createDataFrame([(1, i, "text", "t", box(*b), 600.0, 800.0) for i, b in [(3, (0, 0, 10, 10)), (1, (0, 0, 10, 8)), (2, (0, 1.5, 10, 9.5)), (4, (0, 0, 0, 0))]], schema))
    assert {r["block_id"]: r["duplicate_of"] for r in dup.collect()} == {1: None, 2: 1, 3: 1, 4: None}
    again = spark.createDataFrame([(1, i, "text", t, box(*b), 600.0, 800.0) for i, t, b in [(1, "a b", (0, 0, 10, 10)), (2, "ab", (0, 0, 10, 9)), (3, "ab", (50, 50, 60, 60)), (4, "", (0, 0, 10, 10))]], schema)
    assert {r["block_id"]: r["duplicate_of"] for r in layout.without_duplicates(again).collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_recognised_lines(spark):
    lines = spark.createDataFrame([(1, 1, 1, "world", box(50, 1, 90, 11), 0.8), (1, 1, 2, "hello", box(0, 0, 40, 10), 0.6), (1, 1, 3, "next", box(0, 30, 40, 40), 0.7)], f"page_id long, block_id long, line_id long, text string, bbox {BOX}, confidence double")
    assert layout.joined_lines(lines).first()["text"] == "hello world next"
    blocks = spark.createDataFrame([(1, 1, "paragraph", "hello world", box(0, 0, 100, 20)), (1, 2, "table", "", box(0, 25, 60, 60))], f"page_id long, block_id long, element_type string, text string, bbox {BOX}")
    lost = lines.drop("block_id").unionByName(spark.createDataFrame([(1, 4, "alone", box(0, 100, 40, 110), 0.5)], f"page_id long, line_id long, text string, bbox {BOX}, confidence double"))
    assert [r["line_id"] for r in layout.uncovered_lines(lost, blocks).collect()] == [4]
    extra = spark.createDataFrame([(1, 9, box(0, 22, 40, 24))], f"page_id long, line_id long, bbox {BOX}")
    assert [r["item"] for r in layout.inserted_lines(blocks, extra).orderBy("order").collect()] == ["b1", "l9", "b2"]


def test_html_tables(spark):
    source = "<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>1</td><td>x<br>y &amp; z</td></tr></table>"
    row = spark.createDataFrame([(1, source)], "table_id int, h string").withColumn("cells", tables.html_cells("h"))
    cells = row.select("table_id", F.inline("cells"))
    assert [(c["row_index"], c["column_index"], c["text"]) for c in cells.collect()] == [(0, 0, "A"), (0, 1, "B"), (1, 1, "1"), (1, 2, "x\ny & z")]
    assert tables.grid_lines(cells).first()["markdown"] == "| A | B | B |\n| A | 1 | x y & z |\n| --- | --- | --- |"
    assert row.select(tables.cells_html(F.col("cells"))).first()[0] == '<table><tr><th rowspan="2">A</th><th colspan="2">B</th></tr><tr><td>1</td><td>x\ny &amp; z</td></tr></table>'


def test_text_after_a_nested_table_stays_in_its_cell(spark):
    source = "<table><tr><td>a\n  a2<table><tr><td> x </td><td>y</td></tr></table>b</td><td>c</td></tr><tr><td>d</td></tr></table>"
    rows = spark.createDataFrame([(source,), ("<table><tr><td>z</table>",), (None,)], "h string")
    got = rows.select(tables.html_cells("h").alias("c"), tables.has_nested_table("h").alias("n")).collect()
    assert [(c["row_index"], c["column_index"], c["text"]) for c in got[0]["c"]] == [(0, 0, "a\na2 x yb"), (0, 1, "c"), (1, 0, "d")]
    assert [r["n"] for r in got] == [True, False, False] and [c["text"] for c in got[1]["c"]] == ["z"] and got[2]["c"] == []


def test_table_regions_and_order(spark):
    used = spark.createDataFrame([("s", r, c) for r, c in [(1, 1), (1, 2), (2, 1), (2, 5), (6, 1)]], "sheet string, row int, column int")
    merged = spark.createDataFrame([("s", 2, 1, 2, 2), ("s", 9, 9, 9, 9)], "sheet string, row1 int, column1 int, row2 int, column2 int")
    got = sorted((r["row1"], r["column1"], r["row2"], r["column2"]) for r in tables.table_regions(used, merged).collect())
    assert got == [(1, 1, 2, 2), (2, 5, 2, 5), (6, 1, 6, 1)]
    cells = spark.createDataFrame([(1, 0, 0, box(0, 50, 10, 60)), (1, 1, 0, box(0, 0, 10, 10))], f"table_id int, row_index int, column_index int, bbox {BOX}")
    assert sorted((r["row_index"], r["bbox"]["y0"]) for r in tables.reindexed(cells).collect()) == [(0, 0.0), (1, 50.0)]


def test_tables_are_matched_once(spark):
    blocks = spark.createDataFrame([(1, i, box(*b)) for i, b in [(1, (0, 0, 10, 10)), (2, (20, 0, 30, 10)), (3, (50, 50, 60, 60))]], f"page_id long, block_id long, bbox {BOX}")
    results = spark.createDataFrame([(1, 7, None, box(21, 0, 30, 10)), (1, 8, 1, box(90, 90, 99, 99)), (1, 9, None, box(70, 0, 80, 10))], f"page_id long, result_id long, for_block long, bbox {BOX}")
    assert {(r["block_id"], r["result_id"], r["how"]) for r in tables.matched_tables(blocks, results).collect()} == {(1, 8, "id"), (2, 7, "overlap"), (3, 9, "position")}


def test_memory_keeps_budgets():
    turns, summary = [], ""
    for i in range(9):
        turns, summary = sessions.remember(turns, summary, "user", f"message {i}")
    assert [t for _, t in turns] == [f"message {i}" for i in range(3, 9)] and summary.startswith("- user: message 0\n- user: message 1")
    turns, summary = sessions.remember([("user", "a" * 50)], "", "assistant", "b" * 99, max_chars=60)
    assert turns == [("assistant", "b" * 60)] and "- user: a" in summary


def test_exchanges_and_deletes(spark):
    schema = "id string, title string, updated_at int, revision int"
    c = spark.createDataFrame([("a", "", 1, 0), ("b", "old", 1, 5)], schema)
    e = spark.createDataFrame([("a", 0, "first question", 9), ("b", 4, "late", 9)], "id string, revision int, question string, at int")
    done, conflicts = sessions.exchanges_applied(c, e)
    assert sorted(map(tuple, done.collect())) == [("a", "first question", 9, 1), ("b", "old", 1, 5)] and conflicts.first()["id"] == "b"
    m = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    left, messages = sessions.without(c, m, spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in left.collect()] == ["b"] and [r["session_id"] for r in messages.collect()] == ["b"]
    assert sessions.opened(c, spark.createDataFrame([("a", 1), ("z", 2)], "id string, updated_at int")).count() == 3


def test_telemetry(spark):
    rows = spark.createDataFrame([(1, "success", 10.0, 1.0), (2, "error", 30.0, None), (3, "fallback", None, None)], "id int, status string, runtime_ms double, ttft_ms double")
    s = telemetry.summary(rows).first()
    assert (s["total"], s["error"], s["running"], s["avg_runtime_ms"], s["avg_ttft_ms"], s["ttft_count"]) == (3, 1, 0, 20.0, 1.0, 1)
    assert telemetry.summary(rows.limit(0)).first()["success"] == 0


def test_calibration(spark):
    q = spark.createDataFrame([(1, False, "x", None, None), (2, True, None, None, None)], "question_id int, expect_fallback boolean, expect_contains string, expect_type string, source_doc long")
    chunks = spark.createDataFrame([(1, 1, "has x", "text", 7, 0.8), (1, 2, "none", "text", 7, 0.9)], "question_id int, rank int, content string, type string, doc_id long, dense double")
    out = lambda s: spark.createDataFrame([(1, False, 0.9), (2, True, s)], "question_id int, fallback boolean, best_score double")
    assert evaluate.calibration(q, chunks, out(0.4)).first()["threshold"] == pytest.approx(0.6)
    assert evaluate.calibration(q, chunks, out(0.85)).first()["error"] == "no threshold separates the labeled questions"
    assert evaluate.calibration(q.where("not expect_fallback"), chunks, out(0.4)).first()["error"].startswith("calibration requires")
    graded = evaluate.grades(q, chunks, out(0.4))
    assert tuple(evaluate.totals(graded).first()) == (2, 2)


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}"
    chunks = spark.createDataFrame([(str(i), i, "text", f"words number {i}") for i in range(20)], "chunk_id string, doc_id long, type string, content string")
    home = index.build(chunks, root, "g1")
    bad = index.verify(spark, home, 21)
    with pytest.raises(ValueError, match="payload count"):
        index.publish(spark, root, "g1", bad)
    assert index.current(spark, root) is None
    index.publish(spark, root, "g1", index.verify(spark, home, 20))
    assert index.current(spark, root) == home


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def _xlsx() -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB2"><f>SUM(A1)</f><v>3</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(_docx())
    (tmp_path / "sub" / "b.XLSX").write_bytes(_xlsx())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "note.txt").write_text("x")
    assert sorted(r["format"] for r in files.discover(spark, str(tmp_path)).collect()) == ["docx", "docx", "excel"]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).where("path like '%.docx'")
    parsed = files.parse(raw)
    rows = parsed.where("status = 'ok'").orderBy("position").collect()
    assert [(r["element_type"], r["text"], r["heading_level"]) for r in rows] == [("heading", "Title", 1), ("paragraph", "Body text", None), ("table", "| a | b |\n| --- | --- |", None)]
    assert tuple(files.batch_counts(parsed).first()) == (1, 0, 1)
    books = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).where("path like '%XLSX'")
    assert [(r["coordinate"], r["row"], r["column"], r["value"], r["formula"]) for r in files.cells(books).orderBy("row").collect()] == [("A1", 1, 1, "head", None), ("AB2", 2, 28, "3", "=SUM(A1)")]


def test_html_blocks():
    assert html.blocks("<nav><p>no</p></nav><h2>T <b>x</b></h2><script>p='<p>'</script><p>one<p>two</p><ul><li>l</ul>") == [("heading", 2, "T x"), ("paragraph", None, "one"), ("paragraph", None, "two"), ("list", None, "l")]


def test_more_questions_than_one_block(spark, monkeypatch):
    rows = [(i, [float(i % 5), 1.0 + i % 3, -float(i % 2)]) for i in range(11)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = store.withColumnRenamed("vec_id", "question_id")
    found = lambda: sorted(tuple(r) for r in dense.dense_top(asked, store, 4, key="vec_id").collect())
    want = found()
    monkeypatch.setattr(dense, "QUERY_LIMIT", 3)
    assert len(want) == 44 and [(*g[:2], round(g[2], 9), g[3]) for g in found()] == [(*w[:2], round(w[2], 9), w[3]) for w in want]
    assert dense.cosine_scores(asked.limit(0), store, key="vec_id").count() == 0
