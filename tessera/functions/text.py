"""Text functions as Spark columns. Python runs only where Spark has no such function (NFC/NFKC), and then only for rows that need it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscore in any script: the Unicode meaning of a word character.
WORD_CHARS = r"[\p{L}\p{N}_]"

# Parser labels and the element types they stand for.
LABELS = {
    "text": "paragraph", "title": "heading", "doc_title": "heading", "paragraph_title": "heading", "section_header": "heading",
    "list_item": "list", "picture": "image", "figure": "image", "chart": "image", "seal": "image", "display_formula": "formula",
    "equation": "formula", "page_header": "header", "page_footer": "footer", "page_number": "footer", "caption": "paragraph",
    "figure_title": "paragraph", "table_title": "paragraph", "reference": "paragraph", "figure_caption": "paragraph",
    "table_caption": "paragraph", "figure_table_chart_title": "paragraph", "number": "footer", "footnote": "footer",
    "algorithm": "paragraph", "code": "paragraph", "abstract": "paragraph", "content": "paragraph", "reference_content": "paragraph",
}
ELEMENT_TYPES = ["heading", "paragraph", "list", "table", "image", "formula", "header", "footer", "unknown"]
# Phrases of an injection attempt, hints of a follow-up question, and the fallback answer.
INJECTION = r"(?iU)bỏ qua (?:mọi )?chỉ dẫn|ignore (?:all )?instructions|system prompt|jailbreak|do anything now"
FOLLOWUP_HINTS = ["còn", "thì sao", "thế còn", "vậy", "nó", "đó", "này", "tiếp", "sao ạ", "sao?"]
# Tone marks moved to the second vowel, and typographic punctuation.
TONES = {
    "òa": "oà", "óa": "oá", "ỏa": "oả", "õa": "oã", "ọa": "oạ", "òe": "oè", "óe": "oé", "ỏe": "oẻ", "õe": "oẽ", "ọe": "oẹ",
    "ùy": "uỳ", "úy": "uý", "ủy": "uỷ", "ũy": "uỹ", "ụy": "uỵ",
}
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "..."}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def normalise(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalise


def nfc(text: Column) -> Column:
    """NFC. The query planner evaluates a Python function for every row, so only rows with combining marks are given text."""
    needs = text.rlike(r"[\p{M}̀-ͅᄀ-ᇿΩKÅ豈-﫿]")
    return F.coalesce(_normal_form("NFC")(F.when(needs, text)), text)


def nfkc_key(text: Column) -> Column:
    """NFKC, case-folded, without white space: the key by which recognised texts are matched."""

    @F.pandas_udf(T.StringType())
    def key(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return key(text)


def tokens(text: Column) -> Column:
    """Lower-case words of the text's NFC, for lexical search."""
    return F.regexp_extract_all(F.lower(nfc(text)), F.lit(f"{WORD_CHARS}+"), F.lit(0))


def compact(text: Column) -> Column:
    """NFC without white space."""
    return F.regexp_replace(nfc(text), r"(?U)\s+", "")


def element_type(label: Column) -> Column:
    """The element type of a parser label; unknown labels are ``unknown``."""
    low = F.lower(F.coalesce(label, F.lit("unknown")))
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    mapped = F.coalesce(F.element_at(known, low), low)
    return F.when(mapped.isin(ELEMENT_TYPES), mapped).otherwise("unknown")


def slug(text: Column) -> Column:
    """Lower case, other runs than word characters and hyphens as one hyphen, none at the ends, 80 characters."""
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_-]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)


def section_slug(text: Column, order: Column) -> Column:
    s = slug(text)
    return F.concat(F.when(s == "", "section").otherwise(s), F.lit("-"), (order + 1).cast("string"))


def text_metrics(text: Column) -> dict[str, Column]:
    """printable_ratio, invalid_ratio and quality of a text; an empty one is perfect."""
    size = F.length(text)
    lost = lambda pattern: size - F.length(F.regexp_replace(text, pattern, ""))
    invalid = lost(r"[�\p{Cc}\p{Cs}\p{Co}\p{Cn}&&[^\n\r\t]]") / size
    printable = 1 - lost(r"[\p{C}\p{Z}&&[^ \n\r\t]]") / size
    empty = F.coalesce(text, F.lit("")) == ""
    put = lambda c, default: F.when(empty, F.lit(default)).otherwise(c)
    return {"printable_ratio": put(printable, 1.0), "invalid_ratio": put(invalid, 0.0), "quality": put(F.greatest(F.lit(0.0), printable * (1 - invalid)), 1.0)}


def roman_value(text: Column) -> Column:
    """The value of a Roman numeral in capitals; null for other letters."""
    value = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    digits = F.transform(F.split(text, ""), lambda c: F.element_at(value, c))
    following = F.concat(F.slice(digits, 2, 64), F.array(F.lit(0)))
    signed = F.zip_with(digits, following, lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.when(text.rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda total, x: total + x))


def roman_text(number: Column) -> Column:
    """Roman numeral of 1 to 3999, from each decimal digit's pattern."""
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    out = F.lit("")
    for scale, (one, five, ten) in ((1000, "M  "), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        shapes = F.array(*[F.lit(s.translate(str.maketrans("IVX", one + five + ten))) for s in ones])
        out = F.concat(out, F.element_at(shapes, (F.floor(number / scale) % 10 + 1).cast("int")))
    return out


def split_years(text: Column) -> Column:
    """Array of (observed, suggested) of years written in two halves."""
    pattern = r"(?iU)\bnăm\s+([12]\d)\s+(\d{2})\b"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda y: F.struct(y.alias("observed"), F.concat(F.lit("năm "), F.regexp_extract(y, pattern, 1), F.regexp_extract(y, pattern, 2)).alias("suggested")))


def markdown_table(rows: Column) -> Column:
    """Markdown of an array of arrays of cell texts; short rows are padded, the first row is the header."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, line)
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n")).otherwise("")


def embedding_text(headings: Column, text: Column) -> Column:
    """The heading path and the text, one a line; the text is not repeated when it is the last heading."""
    repeated = F.coalesce(F.try_element_at(headings, F.lit(-1)) == text, F.lit(False))
    parts = F.when(repeated, headings).otherwise(F.concat(headings, F.array(text)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def citation(file_name: Column, page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit("["), file_name, F.lit(", trang "), page.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), file_name, F.lit("]")))


def input_guard(question: Column, limit: int = 2000) -> dict[str, Column]:
    """ok, reason and strict (an injection attempt) of a question."""
    text = F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)^\s+|\s+$", "")
    size = F.length(text)
    ok = (size > 0) & (size <= limit)
    reason = F.when(size == 0, "empty question").when(size > limit, F.concat(F.lit("question too long ("), size.cast("string"), F.lit(f" > {limit})"))).otherwise("")
    return {"ok": ok, "reason": reason, "strict": ok & text.rlike(INJECTION)}


def output_guard(answer: Column, has_context: Column, fallback: str, limit: int = 4000) -> dict[str, Column]:
    """ok, answer and reason: the fallback for no context, no output or the model's own fallback; long answers end at a space."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", "")
    bare = F.btrim(F.lower(text), F.lit(" \t\r\n\"'“”«».!…"))
    none, own = ~has_context | (text == ""), bare == F.lit(fallback.lower().strip(" \t\r\n\"'“”«».!…"))
    own = own | (bare == F.lit(fallback.lower()))
    cut = F.substring(text, 1, limit)
    clipped = F.when(F.length(text) > limit, F.concat(F.regexp_replace(cut, r"(?s) [^ ]*$", ""), F.lit("…"))).otherwise(text)
    return {"ok": ~none & ~own, "answer": F.when(none | own, F.lit(fallback)).otherwise(clipped), "reason": F.when(none, "no context or empty model output").when(own, "model fallback").otherwise("")}


def is_followup(question: Column) -> Column:
    hints = "|".join(h.replace("?", r"\?") for h in FOLLOWUP_HINTS)
    return F.lower(question).rlike(rf"(?<!{WORD_CHARS})(?:{hints})(?!{WORD_CHARS})")


def tone_normalised(text: Column) -> Column:
    """Typographic punctuation made plain and tone marks moved to their other accepted place."""
    for a, b in PUNCTUATION.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    for a, b in TONES.items():
        text = F.replace(F.replace(text, F.lit(a), F.lit(b)), F.lit(a.capitalize()), F.lit(b.capitalize()))
    return F.trim(text)


def safe_asset_path(path: Column) -> Column:
    """Whether a path stays inside its root and names an image."""
    return ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike("\\x00") & ~path.startswith("/") & F.lower(path).rlike(r"\.(png|jpe?g|gif|webp|bmp|tiff?)$")
