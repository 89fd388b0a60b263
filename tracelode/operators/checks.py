"""Record checks, section tables, rankings and rollups on small to mid-sized relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import similarity as S
from tracelode.operators.ordering import equal_ranges
from tracelode.session import materialise

#: Ranges that a column is cut into to rank its values.
RANGES = 10_000


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold (null counts as failed), in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))


def candidate_checks(rows: DataFrame, body: str, task: str, overlap: Column | None = None, least_body: int = 50, least_task: int = 10) -> DataFrame:
    """Adds ``failed``: body too short, neither front matter nor heading, task too short, overlap above a half."""
    b = F.coalesce(body, F.lit(""))
    checks = {
        "body_length": F.length(b) >= least_body, "structure": F.ltrim(b).startswith("---") | b.rlike(r"(?m)^#{1,3}\s"), "task": F.length(F.coalesce(task, F.lit(""))) >= least_task,
        "overlap": (overlap <= 0.5) if overlap is not None else F.lit(True),
    }
    return rows.withColumn("failed", failed_checks(checks))


def missing_paths(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Adds ``missing``: the dotted paths that are null or not in the schema at all."""

    def there(path: str) -> Column:
        kind = rows.schema
        for part in path.split("."):
            if not hasattr(kind, "names") or part not in kind.names:
                return F.lit(False)
            kind = kind[part].dataType
        return F.col(path).isNotNull()

    return rows.withColumn("missing", failed_checks({p: there(p) for p in paths}))


def contract_failures(items: DataFrame, required: list[str], enums: dict[str, tuple[str, ...]], limits: dict[str, int]) -> DataFrame:
    """Adds ``failed``: blank required fields, values outside their enum, texts over their limit."""
    checks = {f"missing {c}": F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in required}
    checks |= {f"{c} not allowed": F.col(c).isNull() | F.col(c).isin(*v) for c, v in enums.items()}
    checks |= {f"{c} too long": F.length(F.coalesce(c, F.lit(""))) <= n for c, n in limits.items()}
    return items.withColumn("failed", failed_checks(checks))


def recent_sessions(sessions: DataFrame, messages: DataFrame, since: Column, least: int) -> DataFrame:
    """Sessions started since a time with at least ``least`` messages, counted by a left join after a pre-aggregation."""
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    joined = sessions.filter(F.col("started_at") >= since).join(n, "session_id", "left").fillna(0, ["messages"])
    return joined.filter(F.col("messages") >= least)


def selection_accuracy(rows: DataFrame, predicted: str, wanted: str) -> DataFrame:
    """(n, accuracy): equal without case and outer blanks; a null prediction is wrong."""
    hit = F.coalesce(F.lower(F.trim(predicted)) == F.lower(F.trim(wanted)), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)), 6).alias("accuracy"))


def benchmark_summary(runs: DataFrame, approach: Column, success: Column, diversity: Column, cases: Column) -> DataFrame:
    """Per approach: success rate, mean and population deviation of diversity, cases per successful run."""
    ok = F.coalesce(success, F.lit(False))
    return runs.groupBy(approach.alias("approach")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(ok.cast("double")), 4).alias("success_rate"), F.round(F.coalesce(F.avg(diversity), F.lit(0.0)), 4).alias("mean_diversity"),
        F.round(F.coalesce(F.stddev_pop(diversity), F.lit(0.0)), 4).alias("std_diversity"), F.round(F.coalesce(F.try_divide(F.sum(cases), F.count_if(ok)), F.lit(0.0)), 2).alias("cases_per_success"),
    )


def weakest(rows: DataFrame, by: str, score: str, tie: str, share: float = 1 / 3) -> DataFrame:
    """Per group the lowest-scored third of the rows, at least one (ties by another column)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(score, tie))
    return rows.withColumn("__n", n).withColumn("rank", rank).filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__n")


def by_priority(rows: DataFrame, ranks: dict[str, int], priority: str, due: str, tie: str) -> DataFrame:
    """Ordered by the rank of the priority (unknown last), then the due date (missing last)."""
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(priority)], F.lit(len(ranks)))
    return rows.orderBy(order, F.coalesce(F.col(due).cast("string"), F.lit("9999-99-99")), tie)


def description_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, before, after) of descriptions that both tables have and that differ."""
    n = new.select("name", F.col("description").alias("after"))
    return old.select("name", F.col("description").alias("before")).join(n, "name").filter(~F.col("before").eqNullSafe(F.col("after")))


def ordered_halves(rows: DataFrame, order: str) -> DataFrame:
    """Order-preserving split: half train, half of the rest val, the rest holdout. The rank comes from ranges of
    the order column (numeric): sizes of up to RANGES equal ranges first, then places within a range."""
    r = rows.select(order).withColumn("range", equal_ranges(rows, order, RANGES))
    sizes = r.groupBy("range").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("before"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("n"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) + F.col("before")
    a = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    b = a + F.greatest(F.lit(1), F.floor((F.col("n") - a) / 2))
    ranked = r.join(sizes, "range").withColumn("place", place)
    return ranked.select(order, F.when(F.col("place") <= a, "train").when(F.col("place") <= b, "val").otherwise("holdout").alias("split"))


def sections(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, section_no, section): a text cut before each line that opens a second-level heading; blanks dropped."""
    parts = F.filter(F.transform(F.split(column, r"(?md)^(?=##[ \t])"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 0)
    return rows.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("section_no", "section"))


def rubric(body: Column, most: int = 800, fallback: int = 500) -> Column:
    """Text of the first section that has any below its first line, cut; else the beginning of the body."""
    inner = F.transform(F.split(T.body(body), r"\n(?=##?[ \t])"), lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"^[^\n]*\n?", ""), r"^\s+|\s+$", ""))
    first = F.try_element_at(F.filter(inner, lambda s: F.length(s) > 0), F.lit(1))
    return F.coalesce(F.substring(first, 1, most), F.substring(body, 1, fallback))


def section_similarity(pairs: DataFrame, features: int = 3000) -> DataFrame:
    """(doc_id, similarity): mean over the evolved sections of their best TF-IDF cosine with a baseline section.

    The vocabulary is fitted on all baseline sections. Sections meet through common terms within one pair of
    versions; a section without a common term counts 0.
    """
    key = F.concat_ws(":", "id", "section_no").alias("sid")
    old = sections(pairs, "doc_id", "baseline").select("id", key, "section")
    new = sections(pairs, "doc_id", "evolved").select("id", key, "section")
    counts = materialise(S.term_counts(old, "sid", F.col("section")), "terms")
    vocab = materialise(S.vocabulary(counts, old, features), "vocabulary")
    a = S.weights(S.term_counts(new, "sid", F.col("section")), vocab).withColumn("doc", F.substring_index("id", ":", 1))
    b = S.weights(counts, vocab).select(F.col("id").alias("other"), F.substring_index("id", ":", 1).alias("doc"), "term", F.col("w").alias("v"))
    best = a.join(b, ["doc", "term"]).groupBy("doc", "id", "other").agg(F.sum(F.col("w") * F.col("v")).alias("c")).groupBy("doc", "id").agg(F.max("c").alias("c"))
    total = best.groupBy("doc").agg(F.sum("c").alias("s"))
    n = new.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, n["id"].cast("string") == total["doc"], "left").select(F.col("id").alias("doc_id"), F.round(F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n"), 5).alias("similarity"))


def verdict_rollup(results: DataFrame, by: str, passed: Column, critical: Column) -> DataFrame:
    """Per group how many results passed and failed, and whether all critical ones passed."""
    p = F.coalesce(passed, F.lit(False))
    return results.groupBy(by).agg(F.count_if(p).alias("passed"), F.count_if(~p).alias("failed"), F.coalesce(F.bool_and(p | ~critical), F.lit(True)).alias("eligible"))


def audit_with_runs(audit: DataFrame, strongest: DataFrame, skill: str = "group") -> DataFrame:
    """Dataset audits beside the skills' strongest improvements; audits without runs stay."""
    return audit.join(strongest.select(F.col("skill").alias(skill), "improvement"), skill, "left")


def titled_sections(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, section, n_lines, body): a text's parts under their heading line of level 1 to 6, "_preamble" before the
    first; parts under the same heading are one, in order. Headings keep their marks; "# " differs from "## "."""
    parts = F.posexplode(F.split(column, r"(?md)^(?=#{1,6}[ \t]+\S)")).alias("at", "part")
    p = rows.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), parts)
    head = F.regexp_extract("part", r"(?d)^(#{1,6})[ \t]+([^\n]+)", 0)
    marks, title = F.regexp_extract(head, "^(#{1,6})", 1), F.trim(F.regexp_replace(head, r"^#{1,6}[ \t]+", ""))
    text = F.when(head != "", F.regexp_replace("part", r"(?d)^[^\n]*\n?", "")).otherwise(F.col("part"))
    p = p.select("id", "at", F.when(head != "", F.concat_ws(" ", marks, title)).otherwise("_preamble").alias("section"), text.alias("text"))
    lines = F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + F.when((F.col("text") != "") & ~F.col("text").endswith("\n"), 1).otherwise(0)
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return p.groupBy("id", "section").agg(F.sum(lines).alias("n_lines"), merged.alias("body"))


def section_score(text: Column, numbered: float = 0.5, bullets: float = 0.5) -> Column:
    """0 to 1: how well a section is built: length up to 1800, numbered lines and bullets (weighed as the kind of
    section wants them), code, links; less for leftovers such as TODO or none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    part = lambda pattern, full: F.least(F.lit(1.0), F.regexp_count(t, F.lit(pattern)) / full)
    has = lambda pattern: t.rlike(pattern).cast("int")
    score = (
        F.least(F.lit(1.0), F.length(t) / 1800) * 0.25 + part(r"(?m)^\s*\d+[.)]\s+", 6) * 0.35 * numbered + part(r"(?m)^\s*[-*•]\s+", 8) * 0.35 * bullets + has(r"(?s)```.*?```") * 0.05 + has(r"(?i)https?://\S+") * 0.03
        + has("`[^`]+`") * 0.02 - (t.contains("[[]") | t.contains("TODO")).cast("int") * 0.1 - has(r"(?i)\b(none|n/a)\b") * 0.08
    )
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
