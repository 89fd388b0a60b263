"""Column functions on Markdown and plain texts: front matter, sections, terms, counts, diffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic (our own short list).
STOPWORDS = (
    "the and for with that this from are was were been have has had not but they them their there then than when where which while will would should could can may might must into onto over under "
    "about after before because between both each every few more most other some such only own same very just also its his her our your you she him who whom whose what why how all any nor yet per via does did done"
).split()


def front_matter(text: Column) -> Column:
    """The part between the first two ``---`` of a text that begins with one, else ''."""
    parts = F.split(text, "---", 3)
    return F.when(F.ltrim(text).startswith("---") & (F.size(parts) == 3), F.trim(F.get(parts, F.lit(1)))).otherwise(F.lit(""))


def body(text: Column) -> Column:
    parts = F.split(text, "---", 3)
    return F.when(F.ltrim(text).startswith("---") & (F.size(parts) == 3), F.trim(F.get(parts, F.lit(2)))).otherwise(text)


def front_matter_field(text: Column, name: str) -> Column:
    """A ``name: value`` line of the front matter without quotes; the last of several; '' if there is none."""
    values = F.regexp_extract_all(front_matter(text), F.lit(rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$"), F.lit(1))
    return F.coalesce(F.regexp_replace(F.try_element_at(values, F.lit(-1)), "^[\"']|[\"']$", ""), F.lit(""))


def headings(text: Column, levels: str = "1,6") -> Column:
    """Titles of the Markdown headings in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?md)^#{{{levels}}}[ \t]+([^\r\n]+)"), F.lit(1)), lambda x: F.trim(x))


def terms(text: Column) -> Column:
    """Lower-case words of four ASCII letters or more that are no stopwords, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]{4,}"), F.lit(0)), F.lower), lambda w: ~w.isin(*[s for s in STOPWORDS if len(s) >= 4]))


def conditionals(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"\b(if|else|elif|when|case|switch)\b"))


def cut_short(text: Column, most: int = 380) -> Column:
    """At most ``most`` characters, with an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def without_every_third_paragraph(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n\n"), lambda p, i: i % 3 != 2), "\n\n")


def without_headings(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.startswith("#")), "\n")


def word_set(text: Column) -> Column:
    """Distinct blank-separated words in lower case."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    return F.filter(F.array_distinct(words), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """int(3/4 of the words plus 1/4 of the characters)."""
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != ""))
    return (words * 0.75 + F.length(text) * 0.25).cast("bigint")


def structure_counts(text: Column) -> list[Column]:
    """Numbered lines, bullets, code fences, links and headings."""
    count = lambda pattern, name: F.regexp_count(text, F.lit(pattern)).alias(name)
    return [count(r"(?m)^\s*\d+[.)]\s", "numbered"), count(r"(?m)^\s*[-*]\s", "bullets"), count("```", "fences"), count(r"https?://", "links"), count(r"(?m)^#{1,6}\s", "headings")]


def growth(before: Column, after: Column) -> Column:
    """Relative change in length."""
    return (F.length(after) - F.length(before)) / F.greatest(F.lit(1), F.length(before))


def parse_score(column: str, default: float = 0.5) -> Column:
    """A number kept within 0 and 1, or the default if the text is none."""
    x = F.expr(f"try_cast(trim(`{column}`) as double)")
    return F.when(x.isNull() | F.isnan(x), default).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def age_hours(text: Column) -> Column:
    """Hours of '72h', '1d', '2w' or a bare number; null if unreadable."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)([hdw]?)$", 1)
    unit = F.regexp_extract(t, r"^(\d+)([hdw]?)$", 2)
    return F.when(n != "", n.cast("bigint") * F.when(unit == "d", 24).when(unit == "w", 168).otherwise(1))
