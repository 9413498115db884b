import hashlib
import re

import pytest

from tessera.llm import private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def listed(text):
    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


TEXTS = [
    None, "", "😀 mail a.b+c@x-y.co.uk, d@e and f@g.h%i@j.kl", "1.2.3.4 256.1.1.1 001.02.3.0255 1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111111",
    "+1 (415) 555-2671. +49 30 1234567 +123 +1234567890123456", "é 4012888888881881x@y.z +44 20 7946 0958", "a@b.c@d.e", "%@a.b " * 30, "1" * 30_000, "1 " * 20_000, "a" * 60_000 + "@x.yz", "12--34 5555-5555-5555-4444", "@@a.b@c.d..e@f.g.",
]


def test_base_spans(make_docs):
    docs = make_docs(list(enumerate(TEXTS)))
    got = private.found_spans(docs).select("doc_id", private._listed({k: k for k in PLAIN}).alias("spans"), "text").collect()
    for r in got:
        assert r["spans"] == listed(TEXTS[r["doc_id"]]), r["doc_id"]


def test_query_digest(spark, make_docs, tmp_path):
    make_docs(list(enumerate(TEXTS))).write.parquet(str(tmp_path / "documents.parquet"))
    rows = private.op2_private_data(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = listed(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)
        assert [r[f"n_{k}"] for k in PLAIN] == [len(re.findall(rf"\b{k}:", want)) for k in PLAIN]


@pytest.fixture(scope="module")
def corpus(make_docs):
    """'zorblax' stands near one address in four texts and almost nowhere else; 'common' is everywhere."""
    rows = [(i, f"common words number{i % 7} in text {i} go on and on") for i in range(200)]
    rows += [(300 + i, f"common agent Zorblax, writes{i} to boss@secret.example.org from place{i} often") for i in range(4)]
    rows += [(400 + i, f"common note one{i} to other{i}@open.example.org then end") for i in range(4)]
    return make_docs(rows)


def test_disclosing_terms(corpus, spark):
    from tessera.llm.common import Scratch

    terms = {r["term"]: r["action"] for r in private.disclosing_terms(private.base_spans(corpus), corpus, Scratch(spark, "t")).collect()}
    assert terms.get("zorblax") == "remove"
    assert "common" not in terms and "note" not in terms


def test_sanitised(corpus, make_docs):
    out = private.sanitised(corpus)
    assert out.columns == corpus.columns
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "Zorblax" not in text[300] and "[EMAIL]" in text[300] and "boss@" not in text[300]
    assert text[5] == "common words number5 in text 5 go on and on"
    assert text[401].count("[EMAIL]") == 1 and "note one1" in text[401]


def test_copies_of_one_text_prove_nothing(make_docs, spark):
    from tessera.llm.common import Scratch

    docs = make_docs([(i, "rareword beside x@y.zz here") for i in range(50)] + [(100 + i, f"filler {i}") for i in range(500)])
    assert private.disclosing_terms(private.base_spans(docs), docs, Scratch(spark, "t")).count() == 0


def test_odd_documents_and_empty_table(odd_docs, make_docs):
    assert private.found_spans(odd_docs).count() == 13
    assert sorted(r["doc_id"] or -1 for r in private.sanitised(odd_docs).collect()) == sorted(r["doc_id"] or -1 for r in odd_docs.collect())
    assert private.sanitised(make_docs([])).collect() == []


def actions(docs, spark):
    from tessera.llm.common import Scratch

    return {r["term"]: r["action"] for r in private.disclosing_terms(private.base_spans(docs), docs, Scratch(spark, "t")).collect()}


def test_an_entity_of_two_texts_is_judged(make_docs, spark):
    rows = [(i, f"filler words of text {i}") for i in range(300)] + [(400 + i, f"then quarzine {w} wrote to x@y.zz again{w}") for i, w in enumerate(("first", "second"))]
    got = actions(make_docs(rows), spark)
    assert got["quarzine"] == "generalise" and not {"first", "second", "filler"} & set(got)


def test_terms_at_the_edges_and_far_from_the_entity(make_docs, spark):
    far = " ".join(f"filler{i % 9}" for i in range(80))
    rows = [(i, f"filler words of text {i} {far}") for i in range(300)]
    rows += [(400 + i, f"Zorblax: x@y.zz {far} in\tplace{i} {far} Quarzine") for i in range(4)] + [(500 + i, f"part{i} pre-x@y.zz-post x@y.zz\n+49 30 1234567 Inner 1.2.3.4") for i in range(4)]
    got = actions(make_docs(rows), spark)
    assert got["zorblax"] == got["quarzine"] == got["inner"] == "remove"
    assert not any("x@y" in t or "1234567" in t or "+49" in t or "post" in t for t in got)


def test_identifiers_disclose(make_docs, spark):
    rows = [(i, f"filler words of text {i}") for i in range(300)] + [(400 + i, f"case{i} emp-4471 acct77 K9 @desk writes to x@y.zz") for i in range(4)]
    got = actions(make_docs(rows), spark)
    assert {got.get(t) for t in ("emp-4471", "acct77", "k9", "@desk")} == {"remove"} and "" not in got and "case1" not in got
