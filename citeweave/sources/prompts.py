"""Pasted questions and topic packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.text import LINE_END

ID = r"^[A-Za-z]{1,4}\d{1,3}$"


def _lines(texts: DataFrame, text_col: str, header: str) -> DataFrame:
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    rows = texts.select(F.posexplode(F.split(text_col, LINE_END)).alias("pos", "raw")).select("pos", line.alias("line")).where("line <> ''")
    low = F.lower("line")
    return rows.where(~(low.startswith(header) & low.contains("intent") & low.contains("prompt")))


def simple_prompts(texts: DataFrame, text_col: str = "text", topic: str = "Custom") -> DataFrame:
    """Every line that is not empty is a prompt."""
    return _lines(texts, text_col, "id ").select("pos", F.lit("").alias("id"), F.lit("Custom").alias("intent"), F.col("line").alias("prompt"), F.lit(topic).alias("topic"))


def prompt_block(texts: DataFrame, text_col: str = "text", topic: str = "Custom") -> DataFrame:
    """Lines of id, intent and prompt between tabs, bars or wide spaces; a bare line is a prompt."""
    mark = F.when(F.col("line").contains("\t"), F.split("line", "\t")).when(F.col("line").contains("|"), F.split("line", r"\|")).when(F.col("line").rlike(r"\s{2,}"), F.split("line", r"\s{2,}")).otherwise(F.array("line"))
    parts = F.filter(F.transform(mark, lambda p: F.trim(p)), lambda p: p != "")
    rows = _lines(texts, text_col, "id").select("pos", parts.alias("p")).withColumns({"n": F.size("p"), "named": F.coalesce(F.get("p", F.lit(0)).rlike(ID), F.lit(False))})
    whole, two = F.array_join("p", " "), F.col("n") == 2
    long = F.col("named") & (F.col("n") >= 3)
    ident = F.when(F.col("named") & (F.col("n") >= 2), F.get("p", F.lit(0))).otherwise("")
    intent = F.when(long, F.get("p", F.lit(1))).when(two & ~F.col("named"), F.get("p", F.lit(0))).otherwise("Custom")
    prompt = F.when(long, F.array_join(F.slice("p", F.lit(3), F.greatest(F.col("n"), F.lit(1))), " ")).when(two, F.get("p", F.lit(1))).otherwise(whole)
    return rows.select("pos", ident.alias("id"), intent.alias("intent"), F.trim(prompt).alias("prompt"), F.lit(topic).alias("topic")).where("prompt <> ''")


def topic_items(packs: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Tagged items of topic packs (topic, id, intent, prompt), all or the chosen ones."""
    return packs if topics is None else packs.where(F.col("topic").isin(topics))


def first_questions(items: DataFrame, most: int, *order: str) -> DataFrame:
    """At most ``most`` questions of a study, in a stated order: what a study may cost is bounded by it."""
    return items.orderBy(*order).limit(most)
