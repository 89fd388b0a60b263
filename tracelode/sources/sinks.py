"""Writers: dataset splits, append-only logs, reports and boards. Spark's commit protocol makes each write whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_splits(examples: DataFrame, path: str) -> None:
    """JSON lines by split; null fields are left out."""
    examples.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "true").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a score log, laid out by skill so that reads of one skill skip the others."""
    rows.write.mode("append").partitionBy("skill_name").parquet(path)


def error_row(row: DataFrame, flag: str) -> DataFrame:
    """A log row of a failed judgement: score 0 and a marker for the text."""
    return row.withColumn("raw_score", F.lit(0.0)).withColumn("actual_behavior", F.lit("[ERROR]")).withColumn("error_flag", F.lit(flag))


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", "true").csv(path)


def report_json(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Each row as JSON with the sizes in bytes and hashes of both texts."""
    extra: list[Column] = [F.octet_length(before).alias("bytes_before"), F.octet_length(after).alias("bytes_after"), F.sha2(before, 256).alias("hash_before"), F.sha2(after, 256).alias("hash_after")]
    rest = [c for c in rows.columns if c not in (before, after)]
    return rows.select(F.to_json(F.struct(*rest, *extra)).alias("report"))


def board(cards: DataFrame, column: str, title: str) -> str:
    """A Markdown board of a card table; the cards of a board fit on a page, the caller limits them."""
    out, last = [], None
    for r in cards.select(column, title).orderBy(column, title).toLocalIterator():
        if r[0] != last:
            out.append(f"\n## {r[0]}\n" if out else f"## {r[0]}\n")
            last = r[0]
        out.append(f"- {r[1]}")
    return "\n".join(out)
