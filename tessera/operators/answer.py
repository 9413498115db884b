"""Answering: guards, prompt, model, citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import hybrid

SYSTEM = f'Chỉ trả lời từ NGỮ CẢNH được cung cấp. Nếu ngữ cảnh không đủ, chỉ trả lời đúng: "{hybrid.FALLBACK}".'
STRICT = " Chế độ nghiêm ngặt: tuyệt đối chỉ dùng ngữ cảnh."


@F.pandas_udf(T.StringType())
def fake_llm(prompt: pd.Series) -> pd.Series:
    """A deterministic stand-in: the first context passage's first line. No prompt, no answer."""
    return prompt.map(lambda p: None if p is None else next((b.split("\n", 1)[1].split("\n")[0] for b in (p or "").split("\n\n") if b.lstrip().startswith("[S1]") and "\n" in b), ""))


def context_block(kept: DataFrame) -> DataFrame:
    """question_id, context, n: numbered, labelled passages in the order of rank."""
    label = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] ["), F.coalesce("file_name", F.lit("")), F.lit(", trang "), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("]\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", label.alias("p"))))
    return kept.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda s: s["p"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n"))


def prompt(context: Column, n: Column, question: Column, history: Column | None = None, summary: Column | None = None) -> Column:
    """User prompt: context, history (last 6 turns of 800 characters, summary of 1000) and question."""
    lines = F.array().cast("array<string>")
    if summary is not None:
        lines = F.concat(lines, F.when(summary != "", F.array(F.concat(F.lit("Tóm tắt hội thoại cũ: "), F.substring(summary, 1, 1000)))).otherwise(F.array().cast("array<string>")))
    if history is not None:
        recent = F.slice(history, F.greatest(F.size(history) - 5, F.lit(1)), F.lit(6))
        lines = F.concat(lines, F.transform(recent, lambda t: F.concat(t["role"], F.lit(": "), F.substring(t["content"], 1, 800))))
    block = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(không có)")
    return F.concat(F.lit("NGỮ CẢNH ("), n.cast("string"), F.lit(" đoạn):\n\n"), context, F.lit("\n\nLỊCH SỬ:\n"), block, F.lit("\n\nCÂU HỎI: "), question)


def answers(questions: DataFrame, kept: DataFrame, outcomes: DataFrame, llm=fake_llm) -> DataFrame:
    """question_id, ok, fallback, reason, answer.

    A question that is refused or has no evidence gets no prompt: the model function sees a null there and must
    return null without running.
    """
    guard = X.input_guard(F.col("question"))
    asked = questions.withColumns({f"in_{k}": c for k, c in guard.items()}).join(outcomes, "question_id")
    full = asked.join(context_block(kept), "question_id", "left").join(hybrid.citations(kept), "question_id", "left")
    live = F.col("in_ok") & ~F.col("fallback") & F.col("context").isNotNull()
    said = full.withColumn("live", live).withColumn("said", llm(F.when(live, prompt(F.col("context"), F.col("n"), F.col("question")))))
    out = X.output_guard(F.col("said"), F.lit(True), hybrid.FALLBACK)
    ok = F.col("live") & out["ok"]
    cited = F.concat(out["answer"], F.lit("\n\nNguồn: "), F.array_join("citations", ", "))
    reason = F.when(~F.col("in_ok"), F.col("in_reason")).when(F.col("fallback"), F.col("reason")).otherwise(out["reason"])
    return said.select("question_id", ok.alias("ok"), (~ok).alias("fallback"), reason.alias("reason"), F.when(ok, cited).otherwise(F.lit(hybrid.FALLBACK)).alias("answer"))
