"""Comparisons of two versions of a text artifact: size, structure, sections, terms, names, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators.ordering import running_sums


def version_pairs(documents: DataFrame, name: str = "skill_name") -> DataFrame:
    """Each text with the one before it of the same name, by time, then id: (doc_id, name, baseline, evolved).

    Only ids are ordered, hour by hour of each name, so that a name with very many versions is no hot spot; the
    texts are joined afterwards.
    """
    named = documents.filter(F.col(name).isNotNull() & F.col("text").isNotNull())
    versions = named.select("doc_id", F.col(name).alias("name"), "written_at")
    hour = F.floor(F.unix_seconds(F.col("written_at").cast("timestamp")) / 3600)
    ids = running_sums(versions, ["name"], hour, ["written_at", "doc_id"], lags={"before": F.col("doc_id")}).filter("before is not null").select("doc_id", "name", "before")
    old = named.select(F.col("doc_id").alias("before"), F.col("text").alias("baseline"))
    return ids.join(old, "before").join(named.select("doc_id", F.col("text").alias("evolved")), "doc_id").select("doc_id", "name", "baseline", "evolved")


def size_checks(pairs: DataFrame, limit: int = 15_000) -> DataFrame:
    """Size limit, non-emptiness and growth within bands that narrow as the baseline gets longer."""
    n = F.length("baseline")
    high = F.when(n < 5_000, 1.0).when(n < 20_000, 0.5).otherwise(0.2)
    low = F.when(n < 5_000, -0.5).when(n < 20_000, -0.3).otherwise(-0.2)
    g = T.growth(F.col("baseline"), F.col("evolved"))
    return pairs.select("doc_id", F.round(g, 6).alias("growth"), g.between(low, high).alias("growth_ok"), (F.length("evolved") <= limit).alias("size_ok"), (F.trim("evolved") != "").alias("non_empty"))


def structure_checks(rows: DataFrame) -> DataFrame:
    """Front matter with name and description, and two of: a heading, procedural words, over 100 characters."""
    head, b = F.substring("text", 1, 500), T.body(F.col("text"))
    fronted = F.ltrim("text").startswith("---") & head.contains("name:") & head.contains("description:")
    steps = F.lit(False)
    for w in ("step", "1.", "procedure", "how to", "instructions"):
        steps = steps | F.lower(b).contains(w)
    passed = b.rlike(r"(?m)^#+\s").cast("int") + steps.cast("int") + (F.length(F.trim(b)) > 100).cast("int")
    return rows.filter("text is not null").select("doc_id", fronted.alias("front_matter"), passed.alias("body_checks"), (fronted & (passed >= 2)).alias("ok"))


def config_drift(pairs: DataFrame, fields: tuple[str, ...] = ("name", "description")) -> DataFrame:
    """Whether front-matter fields are the same in both versions."""
    return pairs.select("doc_id", *((T.front_matter_field(F.col("baseline"), f) == T.front_matter_field(F.col("evolved"), f)).alias(f"same_{f}") for f in fields))


def section_changes(pairs: DataFrame) -> DataFrame:
    """(doc_id, section, change): headings of either version as added, removed or common, by a full outer join."""
    side = lambda c, flag: pairs.select("doc_id", F.explode(F.array_distinct(T.headings(F.col(c)))).alias("section"), F.lit(True).alias(flag))
    both = side("baseline", "old").join(side("evolved", "new"), ["doc_id", "section"], "full")
    return both.select("doc_id", "section", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("common").alias("change"))


def scope_creep(pairs: DataFrame, least: int = 3, minor: float = 0.10, major: float = 0.30) -> DataFrame:
    """New terms that occur ``least`` times or more, against the baseline's words: match, minor or major drift.

    A baseline of fewer than 3 meaningful words gives match.
    """
    count = lambda c: pairs.select("doc_id", F.explode(T.terms(F.col(c))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("k"))
    old, new = count("baseline"), count("evolved")
    fresh = new.filter(F.col("k") >= least).join(old, ["doc_id", "term"], "left_anti").groupBy("doc_id").agg(F.sum("k").alias("fresh"))
    base = old.groupBy("doc_id").agg(F.sum("k").alias("meaningful"))
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(F.trim(F.regexp_replace("baseline", r"\s+", " ")), " "), lambda w: w != "")))
    d = pairs.select("doc_id", words.alias("words")).join(base, "doc_id", "left").join(fresh, "doc_id", "left").fillna(0, ["meaningful", "fresh"])
    ratio = F.col("fresh") / F.col("words")
    status = F.when((F.col("meaningful") < 3) | (ratio < minor), "match").when(ratio < major, "minor_drift").otherwise("major_drift")
    return d.select("doc_id", F.round(ratio, 6).alias("ratio"), status.alias("status"))


def keyword_survival(pairs: DataFrame, groups: dict[str, tuple[str, ...]], least: float = 0.4) -> DataFrame:
    """Share of the baseline's keywords that survive: words of each group of which the text has two or more."""

    def found(c: str) -> Column:
        text = F.lower(c)
        parts = []
        for words in groups.values():
            have = F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))
            parts.append(F.when(F.size(have) >= 2, have).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(F.concat(*parts))

    old, new = found("baseline"), found("evolved")
    ratio = F.coalesce(F.try_divide(F.size(F.array_intersect(old, new)).cast("double"), F.size(old)), F.lit(1.0))
    return pairs.select("doc_id", F.size(old).alias("keywords"), F.round(ratio, 6).alias("survival"), (ratio >= least).alias("preserved"))


def new_conditionals(pairs: DataFrame) -> DataFrame:
    added = F.greatest(F.lit(0), T.conditionals(F.col("evolved")) - T.conditionals(F.col("baseline")))
    return pairs.select("doc_id", added.alias("added"))


def pareto_choice(rows: DataFrame, least: float = 0.03, score_weight: float = 0.85, size_weight: float = 0.15, slack: float = 0.2) -> DataFrame:
    """baseline or evolved by weighted score and size, per row of (id, baseline_score, evolved_score, growth[, robust]).

    Below the noise floor the baseline stays, and where ``robust`` is given and not true; growth beyond ``slack`` costs
    up to the whole size weight.
    """
    gain = F.col("evolved_score") - F.col("baseline_score")
    penalty = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("growth") - slack))
    robust = F.coalesce("robust", F.lit(False)) if "robust" in rows.columns else F.lit(True)
    better = F.col("evolved_score") * score_weight + (1 - penalty) * size_weight > F.col("baseline_score") * score_weight + size_weight
    return rows.select("id", F.when(robust & (gain >= least) & better, "evolved").otherwise("baseline").alias("choice"), F.round(penalty, 6).alias("penalty"))


def dominant_category(failures: DataFrame, by: str, category: Column) -> DataFrame:
    """Per group the most frequent category (ties by name) and its share of all rows."""
    c = failures.groupBy(by, F.coalesce(F.nullif(category, F.lit("")), F.lit("uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("k"))
    top = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("k"), "category"))
    total = F.sum("k").over(Window.partitionBy(by))
    return c.withColumn("r", top).withColumn("share", F.round(F.col("k") / total, 6)).filter("r = 1").select(by, "category", "share")


# Second-level headings of texts that instruct a role, and of texts that document.
ROLE_SECTIONS = (
    "Role", "Context", "Instructions", "Task", "Output Format", "Constraints", "Guidelines", "Persona", "Identity", "Personality", "Key Principles", "Quality Criteria",
    "Scoring Guidance", "Objective", "Main Topic", "Input Format",
)
DOCUMENT_SECTIONS = (
    "Overview", "Steps", "Examples", "Options", "Usage", "Troubleshooting", "Prerequisites", "CLI Reference", "Quick Start", "Key Paths", "Security", "Privacy",
    "Slash Commands", "Spawning", "Voice", "Transcription",
)


def purpose_kept(pairs: DataFrame, groups: dict[str, tuple[str, ...]], role: tuple[str, ...] = ROLE_SECTIONS, document: tuple[str, ...] = DOCUMENT_SECTIONS, least: float = 0.4, survive: float = 0.5, similarity: DataFrame | None = None, alike: float = 0.6) -> DataFrame:
    """(doc_id, verdict): whether a version keeps what the one before it is for.

    keywords_lost: fewer than ``least`` of the baseline's keywords survive; role_lost: role sections of the baseline
    are gone; role_adopted: it had none and the version has; structure_lost: of its documenting sections fewer than
    ``survive`` as many, or none, are left; content_changed: the similarity (doc_id, similarity), where given, is
    below ``alike``; else kept. A baseline without keywords or sections passes those checks.
    """
    had, has = (F.array_distinct(T.headings(F.col(c), "2")) for c in ("baseline", "evolved"))
    pick = lambda titles, of: F.array_intersect(titles, F.array(*map(F.lit, of)))
    d = pairs.select("doc_id", pick(had, role).alias("r0"), pick(has, role).alias("r1"), F.size(pick(had, document)).alias("d0"), F.size(pick(has, document)).alias("d1"))
    d = d.join(keyword_survival(pairs, groups, least).select("doc_id", "preserved"), "doc_id")
    d = d.join(similarity, "doc_id", "left") if similarity is not None else d.withColumn("similarity", F.lit(None).cast("double"))
    verdict = (
        F.when(~F.col("preserved"), "keywords_lost").when(F.size(F.array_except("r0", "r1")) > 0, "role_lost").when((F.size("r0") == 0) & (F.size("r1") > 0), "role_adopted")
        .when((F.size("r0") == 0) & (F.col("d0") > 0) & ((F.col("d1") < survive * F.col("d0")) | (F.col("d1") == 0)), "structure_lost").when(F.col("similarity") < alike, "content_changed").otherwise("kept")
    )
    return d.select("doc_id", verdict.alias("verdict"))


def failure_patterns(results: DataFrame, by: str, passed: Column, reason: Column, hard: tuple[str, ...] = ("hard", "adversarial"), conditionals: Column | None = None, most_hard: float = 0.8, cluster: float = 0.6, fewest: int = 3) -> DataFrame:
    """(by, failures, pattern, confidence): what the failures of a group have in common.

    structural: ``conditionals`` (new branches, a column that is one per group) reach 3; edge_case: the reasons of
    ``most_hard`` of them are hard ones; coverage: of at least ``fewest`` failures ``cluster`` share one reason;
    else noise, also without failures (confidence 1).
    """
    given = results.select(by, F.coalesce(passed, F.lit(False)).alias("ok"), F.coalesce(F.nullif(reason, F.lit("")), F.lit("uncategorized")).alias("reason"), (conditionals if conditionals is not None else F.lit(0)).alias("new"))
    k = given.groupBy(by, "reason").agg(F.count_if(~F.col("ok")).alias("k"), F.max("new").alias("new"))
    g = k.groupBy(by).agg(F.sum("k").alias("failures"), F.max("k").alias("top"), F.sum(F.when(F.col("reason").isin(*hard), F.col("k")).otherwise(0)).alias("hard"), F.max("new").alias("new"))
    n = F.greatest(F.col("failures"), F.lit(1))
    at_edge, clustered = F.col("hard") / n, F.col("top") / n
    some = F.col("failures") > 0
    pattern = F.when(some & (F.col("new") >= 3), "structural").when(some & (at_edge >= most_hard), "edge_case").when((F.col("failures") >= fewest) & (clustered >= cluster), "coverage").otherwise("noise")
    sure = F.when(~some, 1.0).when(F.col("pattern") == "structural", 0.5 + F.col("new") * 0.1).when(F.col("pattern") == "edge_case", 0.5 + at_edge * 0.5).when(F.col("pattern") == "coverage", 0.4 + clustered * 0.4).otherwise(0.5)
    return g.withColumn("pattern", pattern).select(by, "failures", "pattern", F.round(F.least(F.lit(1.0), sure), 6).alias("confidence"))


def new_terms(pairs: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """(doc_id, rank, term, k): the most frequent terms of a version that the one before it lacks (ties by term)."""
    count = lambda c: pairs.select("doc_id", F.explode(T.terms(F.col(c))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("k"))
    fresh = count("evolved").filter(F.col("k") >= least).join(count("baseline"), ["doc_id", "term"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("k"), "term"))
    return fresh.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "rank", "term", "k")
