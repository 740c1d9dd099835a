"""Prompts and checks of generated answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cite

SYSTEM = (
    "You answer legal questions from the given sources alone.",
    "Cite each claim as [N].",
    "Say so if the sources do not hold the answer.",
    "Say so if the sources contradict each other.",
)
#: What an answer says that gives none, in lower case.
ABSTENTION = ("i do not have enough information",) + tuple(f"the {x}" for x in ("answer is not in the provided sources", "provided sources do not contain")) + ("i cannot determine",)
NAME = "[A-Za-z0-9_.+-]+"
EMAIL = rf"\b{NAME}@[A-Za-z0-9_.-]+[.][a-zA-Z]{{2,}}\b"
PHONE = r"\b(?:\+?[0-9][0-9\s().-]{7,}[0-9])\b"


def system_prompt(conflict: Column) -> Column:
    return F.concat(F.lit("\n".join(SYSTEM)), F.when(conflict, "\nThe context carries a conflict warning; address it.").otherwise(""))


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nContext:\n"), context, F.lit("\n\nAnswer with grounded claims only."))


def abstained(answer: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(answer), F.lit(p)) for p in ABSTENTION))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def findings(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row for every e-mail address and phone number: rows' other columns, kind, match, start and end; addresses first."""
    keys = [c for c in rows.columns if c != text]
    kinds = [F.transform(cite._places(F.col(text), p), lambda x: F.struct(F.lit(k).alias("kind"), x["m"].alias("match"), x["start"].cast("bigint").alias("start"), x["end"].cast("bigint").alias("end"))) for k, p in (("email", EMAIL), ("phone", PHONE))]
    return rows.select(*keys, F.explode(F.concat(*kinds)).alias("f")).select(*keys, "f.*")


def validity(answers: DataFrame, resolved: Column) -> DataFrame:
    """valid: no orphan citation and nothing personal."""
    checked = cite.validate(answers, resolved)
    return checked.withColumn("valid", F.col("valid") & (F.size(emails(F.col("answer"))) == 0) & (F.size(phones(F.col("answer"))) == 0))
