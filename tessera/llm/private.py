"""Information-theoretic sanitisation of personal data, in Spark column expressions only.

Patterns find four kinds of personal data in the whole text. What they find are the protected entities. A
term that stands in the same texts as an entity may itself give the entity away: with document frequencies of
both and of the two together, all of whole texts and over the whole corpus, PMI(term; entity) = log2(p(term, entity) / (p(term) p(entity))) is
compared with the entity's information IC(entity) = -log2 p(entity). The bits missing between them are
-log2 p(entity | term), where p is shrunk by k / (k + ``UNSEEN``) for the k different texts it was seen in; a
term leaving no more than ``GENERALISE_BITS`` of them, while its PMI is at least ``LEAST_BITS``, discloses the
entity. Below ``REMOVE_BITS`` it is removed, otherwise generalised. Such terms
are spans in every text that holds them, beside the base spans, which always stay.

Terms are words without the punctuation around them, in lower case, of any length and with any characters; those that overlap an entity are part of
it and are left out. k counts different texts, so copies of one text prove nothing. No entity has a
least support of its own: one text leaves 0.345 bits at best, two leave 0.183, and pairs that even their best
case leaves above ``GENERALISE_BITS`` need no further counting.

Null texts count as empty. Very long texts are scanned whole: the patterns are possessive where that changes
no match, so they need neither deep recursion nor repeated scans. Rows that repeat a doc_id are treated by
their own text. Spans of different kinds may overlap and all count; terms that disclose several entities take the
strongest action, so there are no ties. Extra columns are ignored (sanitised() keeps them); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, documents, whole_text

#: Fixed patterns, in the order in which kinds are listed. Possessive quantifiers and the look-behind before
#: an e-mail's local part save rescans only: a local part can start only where its run of characters does,
#: or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap necessary condition of every kind.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

#: Texts without the entity that every term is taken to have beside those seen. Between 0.257 (one text alone proves
#: nothing) and 0.287 (a term that four texts hold, all with the entity, is removed).
UNSEEN = 0.27
GENERALISE_BITS, REMOVE_BITS, LEAST_BITS = 0.33, 0.1, 4.0
TRIM = ".,;:!?()[]{}\"'*#$%&|"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _accepted(kind: str, match: Column) -> Column:
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        size = F.length(_digits(match))
        return F.when(size.between(13, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _characters(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda total, x: total + F.length(x))


def find_spans(text: Column, pattern: str, accepted=lambda match: F.lit(True)) -> Column:
    """Array of (start, end, value) of the pattern's accepted matches, leftmost and non-overlapping, in code points.

    The pieces between matches and the matches before one add up to its start, so only accepted matches cost
    a sum.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    numbered = F.filter(F.transform(matches, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: accepted(x["m"]))

    def place(x: Column) -> Column:
        start = _characters(F.slice(pieces, F.lit(1), x["i"] + 1)) + _characters(F.slice(matches, F.lit(1), x["i"]))
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

    return F.transform(numbered, place)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and one array of (start, end, value) for each kind."""
    out = docs.select("doc_id", whole_text().alias("text"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return out.withColumns({k: F.when(F.col("text").rlike(HINTS[k]), find_spans(F.col("text"), p, lambda m, k=k: _accepted(k, m))).otherwise(none) for k, p in PATTERNS.items()})


def _with_kind(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _term(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(TRIM))


def _terms_outside(spans: Column) -> Column:
    """The different terms of the words of ``text`` that overlap none of the spans."""
    # White space becomes a space; then a tab marks where an entity was, and the words that it touches.
    text = F.translate("text", "\t\n\x0b\x0c\r", " " * 5)

    def step(acc: Column, s: Column) -> Column:
        part = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], part, F.lit("\t")).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    marked = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    words = F.filter(F.regexp_extract_all(marked, F.lit("[^ ]+"), F.lit(0)), lambda w: ~F.contains(w, F.lit("\t")))
    return F.array_distinct(F.transform(words, _term))


def _shrunk_bits(texts: str) -> Column:
    """What shrinking takes from log2 p(entity | term), for a term and entity seen together in so many texts; falls with them."""
    return F.log2(1 + F.lit(UNSEEN) / F.col(texts))


def disclosing_terms(spans: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """term, action: the terms that give a protected entity away. ``spans``: base_spans() of the same documents."""
    found = spans.where(F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0)
    everything = F.concat(*[_with_kind(k) for k in PATTERNS])
    entities = F.array_distinct(F.transform(everything, lambda s: F.xxhash64(s["kind"], s["value"])))
    texts = found.select(F.xxhash64("text").alias("text_key"), entities.alias("entities"), _terms_outside(everything).alias("terms"))
    texts = scratch.keep(texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("docs"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "texts")

    mentions = texts.select("text_key", "docs", F.explode("entities").alias("entity"))
    widespread = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("docs").alias("entity_docs")).where(_shrunk_bits("texts") <= GENERALISE_BITS)
    widespread = scratch.keep(widespread, "widespread")
    held = mentions.join(widespread.drop("texts"), "entity").join(texts.select("text_key", "terms"), "text_key")
    held = held.select("entity", "entity_docs", "docs", F.explode("terms").alias("term")).where("term != ''")
    joint = held.groupBy("entity", "entity_docs", "term")
    joint = joint.agg(F.count(F.lit(1)).alias("texts"), F.sum("docs").alias("together")).where(_shrunk_bits("texts") <= GENERALISE_BITS)
    joint = scratch.keep(joint, "joint")

    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0)), _term))).alias("term"))
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    total = docs.agg(F.count(F.lit(1))).first()[0]
    rated = joint.join(frequency, "term")
    together = F.least("together", "term_docs", "entity_docs").cast("double")
    pmi = F.log2(together * F.lit(float(max(total, 1))) / (F.col("term_docs") * F.col("entity_docs"))) - _shrunk_bits("texts")
    missing = F.log2(F.col("term_docs") / together) + _shrunk_bits("texts")
    disclosed = rated.where((pmi >= LEAST_BITS) & (missing <= GENERALISE_BITS)).groupBy("term").agg(F.min(missing).alias("missing"))
    return scratch.keep(disclosed.select("term", F.when(F.col("missing") <= REMOVE_BITS, "remove").otherwise("generalise").alias("action")), "terms")


def _trimmed(word: Column, start: Column) -> tuple[Column, Column]:
    """Where the term of a word at ``start`` begins and ends."""
    left = F.length(word) - F.length(F.ltrim(word, F.lit(TRIM)))
    return start + left, start + left + F.length(_term(word))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, the spans of the four base kinds, and term_spans: (start, end, action) of disclosing terms.

    Texts are matched to the disclosing terms they hold by digest, so no doc_id needs to be unique. Only
    those texts are looked at word by word for positions.
    """
    scratch = Scratch(docs.sparkSession, "private")
    base = base_spans(docs)
    none = F.expr("cast(array() as array<struct<start:int,end:int,action:string>>)")
    terms = disclosing_terms(base, docs, scratch)
    if terms.limit(1).count() == 0:
        return base.withColumn("term_spans", none)
    key = F.sha2(whole_text(), 256).alias("doc_key")
    words = docs.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0)), _term))).alias("term"))
    held = words.join(terms, "term").groupBy("doc_key").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", "action")))).alias("actions"))
    held = scratch.keep(held, "held")
    words_of = find_spans(F.col("text"), WORD, lambda w: F.map_contains_key(F.col("actions"), _term(w)))

    def place(s: Column) -> Column:
        start, end = _trimmed(s["value"], s["start"])
        return F.struct(start.alias("start"), end.alias("end"), F.col("actions")[_term(s["value"])].alias("action"))

    keyed = base.withColumn("doc_key", F.sha2("text", 256)).join(held, "doc_key", "left")
    return keyed.withColumn("term_spans", F.when(F.col("actions").isNotNull(), F.transform(words_of, place)).otherwise(none)).drop("doc_key", "actions")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in the text replaced by ``[KIND]``, generalised terms by ``[TERM]``, removed terms dropped.

    Spans that overlap are replaced once, by the first. Rows are matched by doc_id and digest of the text.
    """
    token = lambda c, t: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), t(s).alias("token")))
    spans = F.array_sort(F.concat(*[token(k, lambda s, k=k: F.lit(f"[{k.upper()}]")) for k in PATTERNS], token("term_spans", lambda s: F.when(s["action"] == "remove", "").otherwise("[TERM]"))))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["at"]
        added = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["token"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(clear, added).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = found_spans(docs).where(F.size(spans) > 0).select("doc_id", F.sha2("text", 256).alias("_tessera_key"), done.alias("_tessera_clean")).dropDuplicates(["doc_id", "_tessera_key"])
    changed = Scratch(docs.sparkSession, "sanitised").keep(changed, "changed").withColumnRenamed("doc_id", "_tessera_id")
    joined = docs.join(changed, docs["doc_id"].eqNullSafe(F.col("_tessera_id")) & (F.sha2(whole_text(), 256) == F.col("_tessera_key")), "left")
    return joined.withColumn("text", F.coalesce("_tessera_clean", "text")).select(*docs.columns)


def _listed(columns: dict[str, str]) -> Column:
    """kind:start:end, comma-joined; ``columns`` has the array of each kind."""
    one = lambda k, c: F.transform(c, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[one(k, c) for k, c in columns.items()]), ",")


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {k: k for k in PATTERNS}
    return found_spans(documents(spark, sf_dir)).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_listed(kinds), 256).alias("base_sha256"), _listed(kinds | {"term": "term_spans"}).alias("spans"),
    )
