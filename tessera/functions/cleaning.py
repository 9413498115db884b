"""Text cleaning as Spark columns. What must not be touched is cut out first and put back; lines are joined by what stands on both sides of a break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

# Fixed patterns: what punctuation spacing leaves alone, and lines that start a structural unit.
SPARED = r"(?U)(?:https?://|www\.)\S+|[\w.+-]+@[\w.-]+\.\w+|\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"
STRUCTURAL = r"(?iU)^\s*(?:CHƯƠNG\s+[IVXLCDM]+|PHẦN\s+\S+|MỤC\s+\S+|Điều\s+\d+[A-Za-z]?|Khoản\s+\d+|Điểm\s+[a-zđ]|\d+[.)]|[a-zđ][.)])"
LETTER = r"[\p{L}\p{Nl}\p{No}]"


def _replaced(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, into in rules:
        text = F.regexp_replace(text, pattern, into)
    return text


def _stripped(text: Column) -> Column:
    return _replaced(text, (r"(?U)^\s+|\s+$", ""))


def _normal(text: Column) -> Column:
    return F.replace(X.nfc(text), F.lit("\0"), F.lit(""))


def _spaced(text: Column) -> Column:
    """Punctuation as in print, but not inside addresses and domains."""
    between, spared = F.split(text, SPARED, -1), F.regexp_extract_all(text, F.lit(SPARED), F.lit(0))
    tidy = F.transform(between, lambda part: _replaced(part, (r" +(?=[,;:.!?])", ""), (rf"([,;:!?.])(?={LETTER})", "$1 ")))
    return F.array_join(F.zip_with(tidy, spared, lambda part, kept: F.concat(part, F.coalesce(kept, F.lit("")))), "")


def clean_text(text: Column, punctuation: bool = True) -> Column:
    """NFC, no NUL, single spaces; punctuation spaced as in print."""
    bare = _stripped(_replaced(_normal(text), (r"(?U)[\s&&[^\n]]+", " ")))
    return _spaced(bare) if punctuation else bare


def retrieval_text(text: Column, is_table: Column) -> Column:
    """Text for retrieval: words hyphenated at a line end are joined, wrapped lines too, unless a structural marker opens a line.

    A break between two lines becomes a space if both hold plain text; beside an empty line or a line that opens a unit
    it stays. Tables are only trimmed.
    """
    whole = _replaced(_normal(text), (r"\r\n?", "\n"))
    joined = _replaced(whole, (rf"(?<={LETTER})-\n(?=\p{{Ll}})", ""), (r"(?U)[\s&&[^\n]]+", " "))
    lines = F.transform(F.split(joined, "\n"), F.trim)
    plain = F.transform(lines, lambda line: (line != "") & ~line.rlike(STRUCTURAL))
    previous = F.concat(F.array(F.lit(False)), plain)
    # A column must not stand inside a function over another: it may hold the NFC function, which runs in Python.
    breaks = F.zip_with(plain, F.slice(previous, F.lit(1), F.size(plain)), lambda here, before: F.when(here & before, " ").otherwise("\n"))
    paragraphs = F.array_join(F.zip_with(breaks, lines, lambda gap, line: F.concat(gap, line)), "")
    flowing = clean_text(_replaced(paragraphs, (r"\n{3,}", "\n\n")))
    return F.when(F.coalesce(is_table, F.lit(False)), _stripped(whole)).otherwise(flowing)
