"""Parsing model replies with column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of a label, a score and a reason in free text
LABEL_NAMED = r"(?iU)(?:label|answer|index)\s*[:：]?\s*([01])\b"
LABEL_ALONE = r"(?U)\b([01])\b"
SCORE_NAMED = r"(?iU)score\s*[:：]?\s*([1-5])\b"
SCORE_OF_FIVE = r"(?U)\b([1-5])\s*/\s*5\b"
REASON_NAMED = r"(?isU)(?:reason|explanation|rationale)\s*[:：]\s*(.+)"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not U+0020 only."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def response_text(*candidates: Column) -> Column:
    """First field that holds a non-empty text; null if none does."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def clean_output(text: Column) -> Column:
    """Drop ``<think>...</think>`` parts and trim."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def parse_label(text: Column) -> Column:
    """0 or 1: the whole text, a named label, or the first lone digit; else null."""
    s = strip(text)
    exact = F.when(s.isin("0", "1"), s)
    return F.coalesce(exact, first_match(s, LABEL_NAMED), first_match(s, LABEL_ALONE)).cast("int")


def json_object(text: Column) -> Column:
    """Text of the first ``{`` to the last ``}`` if it parses as an object, else null."""
    body = first_match(text, r"(?s)(\{.*\})")
    return F.when(F.try_parse_json(body).isNotNull(), body)


def with_reply_fields(df: DataFrame, text: str, fields: Sequence[str] = ("label", "reason", "score", "final_label")) -> DataFrame:
    """Add the asked fields of a reply text.

    label: 0 or 1 by :func:`parse_label`.  reason: the JSON keys reason,
    explanation, rationale, else a named part, else the whole text, '' for a bare
    label.  score: 1..5 from the JSON whole number or digit text, ``score: n`` or
    ``n/5``.  final_label: the JSON keys final_label, label, answer, else the
    label rule; JSON true and false count as 1 and 0.

    The text is trimmed and its JSON parsed once, in steps of their own; one
    nested expression would repeat the parsing per field.
    """
    steps = df.withColumn("__s", strip(F.col(text))).withColumn("__body", json_object(F.col("__s")))
    steps = steps.withColumn("__map", F.from_json("__body", "map<string,string>")).withColumn("__var", F.try_parse_json("__body"))
    s, found = F.col("__s"), F.col("__map")

    def text_key(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.col("__var"), f"$.{key}", "variant"))
        return F.when(kind == "STRING", F.nullif(strip(found[key]), F.lit("")))

    def binary_key(key: str) -> Column:
        return F.when(strip(found[key]).isin("1", "1.0", "true"), 1).when(strip(found[key]).isin("0", "0.0", "false"), 0)

    score = F.when(strip(found["score"]) == "true", "1").when(strip(found["score"]).rlike("^0*[1-5]$"), F.right(strip(found["score"]), F.lit(1)))
    makers = {
        "label": lambda: parse_label(s),
        "reason": lambda: F.when(s.isin("0", "1"), "").otherwise(
            F.coalesce(*[text_key(k) for k in ("reason", "explanation", "rationale")], strip(first_match(s, REASON_NAMED)), s)
        ),
        "score": lambda: F.coalesce(score, first_match(s, SCORE_NAMED), first_match(s, SCORE_OF_FIVE)).cast("int"),
        "final_label": lambda: F.coalesce(*[binary_key(k) for k in ("final_label", "label", "answer")], parse_label(s)),
    }
    return steps.select(*df.columns, *[makers[f]().alias(f) for f in fields])
