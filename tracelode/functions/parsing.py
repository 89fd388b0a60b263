"""Text functions that Spark has no expression for, as vectorised Python functions."""

from __future__ import annotations

import ast
import difflib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def first_object(text: str) -> str | None:
    """The first balanced ``{...}`` of a text, braces in strings not counted."""
    start, depth, quoted, escaped = -1, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def repaired(text: str | None) -> object:
    """A JSON value from loosely written text: fences, surrounding prose, trailing commas, single quotes; or None."""
    if not text:
        return None
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    tries = [bare]
    at = min((i for i in (bare.find("["), bare.find("{")) if i >= 0), default=-1)
    if at >= 0:
        tries.append(bare[at : max(bare.rfind("]"), bare.rfind("}")) + 1])
    tries += [re.sub(r",\s*([\]}])", r"\1", x) for x in tries]
    for x in tries:
        try:
            return json.loads(x, strict=False)
        except ValueError:
            pass
    for x in tries:
        try:
            return ast.literal_eval(x)  # literals only, nothing is run
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
    return None


@F.pandas_udf(StringType())
def repair_json(text: pd.Series) -> pd.Series:
    """The text's JSON value in canonical form, null if it has none."""
    return text.map(lambda t: None if (v := repaired(t)) is None else json.dumps(v, sort_keys=True, ensure_ascii=False, default=str))


@F.pandas_udf(StringType())
def scoring_json(text: pd.Series) -> pd.Series:
    """The text as a JSON object, else its first balanced object; null if neither can be read."""

    def read(t: str | None) -> str | None:
        for x in (t, first_object(t) if t else None):
            try:
                v = json.loads(x) if x else None
            except ValueError:
                continue
            if isinstance(v, dict):
                return json.dumps(v, sort_keys=True)
        return None

    return text.map(read)


@F.pandas_udf(StructType([StructField("added", IntegerType()), StructField("removed", IntegerType()), StructField("diff", StringType())]))
def text_diff(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Unified diff of two texts with the numbers of added and removed lines."""
    rows = []
    for a, b in zip(before.fillna(""), after.fillna("")):
        lines = list(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=1))
        rows.append((sum(x.startswith("+") for x in lines[2:]), sum(x.startswith("-") for x in lines[2:]), "\n".join(lines)))
    return pd.DataFrame(rows, columns=["added", "removed", "diff"])


def tagged_payload(text, tag: str = "payload_json"):
    """What stands between <tag> and </tag>, without a code fence."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"^\s*```\w*\s*|\s*```\s*$|^\s+|\s+$", "")


def described(text):
    """Map of the ``- name: description`` lines of a text (a later line wins)."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*]\s*(\w+:\s*\S.*)$"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.trim(F.regexp_extract(x, r"^\w+:\s*(.*)$", 1)).alias("v"), x))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))
