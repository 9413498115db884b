import pytest

#: Columns that a table might carry besides its own; several are names that the operators use inside.
EXTRA = "rank int, size int, length int, first long, component long, a long, b long, block int, score double, words string, kept boolean"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) or (doc_id, text, source) with extra columns of clashing names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or ""), *[None] * 11) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, odd characters."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, long), (7, long), (8, "Ünï çødé 漢字 😀 a b"), (9, "x\x1cy z"), (None, "no id here"), (4, "one"), (10, "0 " * 3000), (11, "a" * 50_000)]
    return make_docs([(*r, None if r[0] in (4, 8) else "s") for r in rows])
