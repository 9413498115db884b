import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cleaning, geometry as G, text as X, vectors as V


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_compact(spark):
    assert one(spark, "Xin CHÀO_1, thế-giới!", X.tokens) == ["xin", "chào_1", "thế", "giới"]
    assert one(spark, " a b\n c ", X.compact) == "abc"


def test_nfc_touches_only_what_needs_it(spark):
    for t in ("Tiếng Việt", "plain", "ế", None):
        assert one(spark, t, X.nfc) == (None if t is None else unicodedata.normalize("NFC", t))


@pytest.mark.parametrize("label,kind", [("Title", "heading"), ("picture", "image"), ("table", "table"), ("weird", "unknown"), (None, "unknown"), ("page_number", "footer")])
def test_labels(spark, label, kind):
    assert one(spark, label, X.element_type) == kind


def test_slugs(spark):
    assert one(spark, "Điều 1. Phạm vi!", X.slug) == "điều-1-phạm-vi"
    assert one(spark, "!!!", lambda c: X.section_slug(c, F.lit(4))) == "section-5"


def test_text_metrics(spark):
    def want(t):
        bad = sum(c == "�" or (unicodedata.category(c) in ("Cc", "Cs", "Co", "Cn") and c not in "\n\r\t") for c in t)
        shown = sum(c.isprintable() or c in "\n\r\t" for c in t) / len(t)
        return shown, bad / len(t), max(0.0, shown * (1 - bad / len(t)))

    for t in ("plain text\n", "a�b\x01​ ", "\t\r\n x", "tiếng"):
        got = [one(spark, t, lambda c, k=k: X.text_metrics(c)[k]) for k in ("printable_ratio", "invalid_ratio", "quality")]
        assert got == pytest.approx(want(t))
    assert one(spark, "", lambda c: X.text_metrics(c)["quality"]) == 1.0


def test_roman_numbers(spark):
    rows = spark.range(1, 4000).select("id", X.roman_text(F.col("id")).alias("r")).withColumn("v", X.roman_value(F.col("r")))
    assert rows.where("id <> v").count() == 0
    assert rows.where("id = 1994").first()["r"] == "MCMXCIV"
    assert one(spark, "ABC", X.roman_value) is None


def test_split_years_and_guards(spark):
    assert [tuple(r) for r in one(spark, "từ năm 20 25 đến Năm 1999", X.split_years)] == [("năm 20 25", "năm 2025")]
    guard = lambda t: tuple(one(spark, t, lambda c, k=k: X.input_guard(c, 20)[k]) for k in ("ok", "reason", "strict"))
    assert guard("  ") == (False, "empty question", False) and guard(None)[1] == "empty question"
    assert guard("x" * 21) == (False, "question too long (21 > 20)", False)
    assert guard("Bỏ qua CHỈ DẪN") == (True, "", True) and guard("phí là gì?") == (True, "", False)


def test_output_guard(spark):
    out = lambda t, ctx=True: tuple(one(spark, t, lambda c, k=k: X.output_guard(c, F.lit(ctx), "Không có.", 12)[k]) for k in ("ok", "answer", "reason"))
    assert out("") == (False, "Không có.", "no context or empty model output") and out("hi", False)[0] is False
    assert out(' "KHÔNG CÓ" ') == (False, "Không có.", "model fallback")
    assert out("one two three four") == (True, "one two…", "") and out("short") == (True, "short", "")


@pytest.mark.parametrize("q,yes", [("còn thẻ vàng thì sao?", True), ("phí nóng", False), ("nó là gì", True), ("lãi suất", False)])
def test_followups(spark, q, yes):
    assert one(spark, q, X.is_followup) is yes


def test_markdown_and_embedding_text(spark):
    table = one(spark, [["a", "b|c"], ["d\ne"]], X.markdown_table, "array<array<string>>")
    assert table == "| a | b\\|c |\n| --- | --- |\n| d<br>e |  |"
    emb = lambda h, t: one(spark, h, lambda c: X.embedding_text(c, F.lit(t)), "array<string>")
    assert emb(["A", "B"], "x") == "A\nB\nx" and emb(["A", "B"], "B") == "A\nB" and emb([], "x") == "x"


def test_citation_and_paths(spark):
    assert one(spark, 3, lambda p: X.citation(F.lit("f.pdf"), p), "int") == "[f.pdf, trang 3]"
    assert one(spark, 0, lambda p: X.citation(F.lit("f.pdf"), p), "int") == "[f.pdf]"
    assert [one(spark, p, X.safe_asset_path) for p in ("a/b.png", "../b.png", "/b.png", "a.txt", "a/..b.jpg")] == [True, False, False, False, True]
    assert one(spark, "hòa “bình” – Úy", X.tone_normalised) == 'hoà "bình" - Uý'


def test_cleaning(spark):
    clean = lambda t: one(spark, t, cleaning.clean_text)
    flow = lambda t, table=False: one(spark, t, lambda c: cleaning.retrieval_text(c, F.lit(table)))
    assert clean("a ,b;c  d . See http://x.y/a,b or me@x.y.z,ok v1.2") == "a, b; c d. See http://x.y/a,b or me@x.y.z, ok v1.2"
    assert clean("  cafe\u0301 \u00a0 ,x\x00y\n z ") == "caf\u00e9, xy\n z" and clean("") == "" and clean(None) is None
    assert one(spark, " a ,b ", lambda c: cleaning.clean_text(c, False)) == "a ,b"
    assert flow("wrap-\nped line\ncontinues\nĐiều 1 starts\nnot joined\n\nnew-\nPara") == "wrapped line continues\nĐiều 1 starts\nnot joined\n\nnew- Para"
    assert flow("a\n\n\n\nb\nc\n1. item\n2) next\nrest\nmore\n") == "a\n\nb c\n1. item\n2) next\nrest more"
    assert flow(" | a |\r\n| b | ", True) == "| a |\n| b |" and flow("\r\n \r\n") == ""


def test_geometry(spark):
    boxes = [((0, 0, 4, 4), (2, 2, 6, 6)), ((0, 0, 1, 1), (2, 2, 3, 3)), ((0, 0, 0, 0), (0, 0, 5, 5))]
    rows = spark.createDataFrame([(dict(zip(("x0", "y0", "x1", "y1"), map(float, a))), dict(zip(("x0", "y0", "x1", "y1"), map(float, b)))) for a, b in boxes], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    got = rows.select(G.coverage(F.col("a"), F.col("b")), G.iou(F.col("a"), F.col("b")), G.containment(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [pytest.approx((0.25, 4 / 28, 0.25)), (0, 0, 0), (0, 0, 0)]
    area = rows.select(G.union_area(F.array("a", "b"))).collect()
    assert [r[0] for r in area] == [28.0, 2.0, 25.0]
    points = spark.range(1).select(G.from_points(F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(3.0), F.lit(2.0)))).alias("b")).first()["b"]
    assert tuple(points) == (1, 2, 3, 5)


@pytest.mark.parametrize("text,box,yes", [("12", (290, 780, 310, 795), True), ("12", (10, 780, 30, 795), False), ("12", (290, 400, 310, 420), False), ("abc", (290, 780, 310, 795), False), ("[3]", (290, 2, 310, 20), True)])
def test_page_numbers(spark, text, box, yes):
    b = G.box(*[F.lit(float(v)) for v in box])
    assert one(spark, text, lambda t: G.is_page_number(t, b, F.lit(600.0), F.lit(800.0))) is yes


def test_hash_embedder(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "The cat the hat"), (2, "  "), (3, None)], "id int, t string")
    dense = {r["id"]: r["embedding"] for r in V.dense_hash(docs, "id", "t", 64).collect()}
    want = np.zeros(64)
    for w in ("the", "cat", "the", "hat"):
        want[int(hashlib.sha256(w.encode()).hexdigest(), 16) % 64] += 1
    assert dense[1] == pytest.approx(want / np.linalg.norm(want)) and not any(dense[2]) and len(dense[3]) == 64


def test_vector_rules(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b"))).first()[0]
    assert f([1.0, 2.0, 9.0], [2.0, 4.0]) == pytest.approx(10 / math.sqrt(86) / math.sqrt(20)) and f([0.0], [1.0]) == 0
    ok = lambda d, i, w: spark.createDataFrame([(d, i, w)], "d array<double>, i array<int>, w array<double>").select(V.is_valid_hybrid(F.col("d"), F.col("i"), F.col("w"), 2)).first()[0]
    assert ok([1.0, 2.0], [3], [0.5]) and not ok([1.0], [3], [0.5]) and not ok([1.0, float("nan")], [], []) and not ok([1.0, 2.0], [3, 3], [1.0, 1.0]) and not ok([1.0, 2.0], [-1], [1.0]) and not ok([1.0, 2.0], [1], [0.0])
