"""Text operators on answers, logs and reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The patterns and stage names the text formats are defined by.
PYTHON_FENCE = r"(?sU)```python\s*(.*?)\s*```"
JSON_FENCE = r"(?m)^```json|```$"
OUTER_SPACE = r"(?U)^\s+|\s+$"
LINE_BREAK = r"\R"
STAGES = ("EDAAgent", "FeatureEngineeringAgent", "ModelTrainingAgent")
DATA_TYPES = ("csv", "images", "text", "excel", "parquet", "json")
TASK_TYPES = ("regression", "classification", "clustering")
INTENTS = ("full_pipeline", "model_training", "feature_engineering", "eda")


def strip(text: Column) -> Column:
    """Remove all outer white space, line breaks included (SQL trim removes blanks only)."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def python_blocks(text: Column) -> Column:
    """All fenced python blocks of a text, trimmed, in order."""
    found = F.regexp_extract_all(text, F.lit(PYTHON_FENCE), F.lit(1))
    return F.transform(found, strip)


def first_block(text: Column) -> Column:
    """The first fenced block, null when there is none."""
    return F.try_element_at(python_blocks(text), F.lit(1))


def strip_json_fence(text: Column) -> Column:
    return strip(F.regexp_replace(text, JSON_FENCE, ""))


def error_signature(stderr: Column) -> Column:
    """The last non-blank line of an error text: a fingerprint of its cause."""
    lines = F.filter(F.split(strip(stderr), LINE_BREAK), lambda line: line.rlike(r"(?U)\S"))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), strip(stderr))


def canonical_stage(name: Column) -> Column:
    """A stage name in its standard spelling, whatever its letter case; others unchanged."""
    out = name
    for stage in STAGES:
        out = F.when(F.lower(strip(name)) == stage.lower(), F.lit(stage)).otherwise(out)
    return out


def merge_stages(*requests: Column) -> Column:
    """Union of requested stage lists, standard spellings, each once, in order of first mention."""
    whole = F.concat(*[F.coalesce(r, F.array().cast("array<string>")) for r in requests])
    return F.array_distinct(F.transform(whole, canonical_stage))


def _found(text: Column, *patterns: str) -> Column:
    hits = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*hits)


def extract_slots(text: Column) -> dict[str, Column]:
    """Slots stated in a message, null where not stated.

    Read are `name: value` pairs (the value is the rest of the line, or what comes before the next
    pair), phrases such as "target column is Quality", "type of data is
    csv", "task type is classification", a path with a known file ending, and the bare words for
    task types and intents.
    """
    types, tasks = "|".join(DATA_TYPES), "|".join(TASK_TYPES)
    names = "data_path|data_type|task_type|target_column|task_intent"
    pair = lambda name: rf"(?m){name}\s*:[ \t]*(\S.*?)[ \t]*(?:\r?$|[,;][ \t]*(?=(?:{names})\s*:))"
    path = r"([A-Za-z0-9_.~:/\\-]+\.(?:csv|parquet|xlsx|txt|json))\b"
    intent = _found(text, r"task_intent\s*:\s*([a-z_]+)", r"\b(full[ _]pipeline|model[ _]training|feature[ _]engineering|eda)\b")
    return {
        "data_path": _found(text, pair("data_path"), r"data path is [\"'`]([^\"'`\n]+)[\"'`]", path),
        "data_type": F.lower(
            _found(
                text, rf"data_type\s*:\s*({types})\b", rf"type of data is (?:an? )?({types})\b",
                rf"data is of type ({types})\b",
            )
        ),
        "task_type": F.lower(_found(text, rf"task_type\s*:\s*({tasks})\b", rf"task type is ({tasks})\b", rf"\b({tasks})\b")),
        "target_column": _found(
            text, pair("target_column"), r"target column is [\"'`]([^\"'`\n]+)[\"'`]", r"target column is (\w+(?:-\w+)*)"
        ),
        "task_intent": F.replace(F.lower(intent), F.lit(" "), F.lit("_")),
    }
