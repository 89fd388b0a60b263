"""Evaluation datasets: validation, secrets, relevance, deduplication, merging, splits, sampling and audits.

Whatever a dataset needs an order for is ordered by example_id or by a hash of the key, so results do not depend
on the layout of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.scorelog import hash_share

DIFFICULTIES = ("easy", "medium", "hard")
SPLIT_ORDER = ("train", "val", "holdout")
# Text forms of keys and credentials, matched without case.
SECRET_FORMS = (
    r"sk-ant-api\S+", r"sk-or-v1-\S+", r"sk-\S{20,}", r"ghp_\S+", r"ghu_\S+", r"xoxb-\S+", r"xapp-\S+", r"ntn_\S+", r"AKIA[0-9A-Z]{16}", r"Bearer\s+\S{20,}",
    r"-----BEGIN\s+(RSA\s+)?PRIVATE\sKEY-----", "ANTHROPIC_API_KEY", "OPENAI_API_KEY", "OPENROUTER_API_KEY", "SLACK_BOT_TOKEN", "GITHUB_TOKEN", "AWS_SECRET_ACCESS_KEY", "DATABASE_URL",
    r"\bpassword\s*[=:]\s*\S+", r"\bsecret\s*[=:]\s*\S+", r"\btoken\s*[=:]\s*\S{10,}",
)
# Words that show what kind of task a text is; earlier kinds win ties.
TASK_KINDS = {
    "investigation": ("investigate", "research", "find evidence", "look for", "search"), "delegation": ("delegate", "spawn", "dispatch", "send to", "assign to"),
    "creation": ("write", "create", "make", "draft", "compose", "save to"), "analysis": ("analyze", "review", "synthesize", "reflect", "assess", "evaluate"),
    "orchestration": ("orchestrate", "coordinate", "manage", "schedule", "plan"), "feedback": ("feedback", "calibrate", "adjust", "correct", "improve"),
    "memory": ("remember", "store", "recall", "mnemosyne", "triple", "forget"),
}


def contains_secret(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iuU)" + "|".join(SECRET_FORMS)), F.lit(False))


def lean(c: str) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.trim(c))


def validated(examples: DataFrame, cut: int = 2000) -> DataFrame:
    """Examples with both texts, enums normalised, blanks defaulted, the task cut to ``cut`` characters."""
    full = (F.trim(F.coalesce("task_input", F.lit(""))) != "") & (F.trim(F.coalesce("expected_behavior", F.lit(""))) != "")
    d = F.coalesce(lean("difficulty"), F.lit("medium"))
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("general"))
    return examples.filter(full).select("example_id", F.substring("task_input", 1, cut).alias("task_input"), F.trim("expected_behavior").alias("expected_behavior"), F.when(d.isin(*DIFFICULTIES), d).otherwise("medium").alias("difficulty"), category.alias("category"))


def canonical_rows(examples: DataFrame) -> DataFrame:
    """The canonical message row of every example: nulls as '', the repository from the project path if missing."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "task_input", "project", "session_id", "message_role", "extraction_reason")]
    repo = F.coalesce(F.nullif(F.trim("repo"), F.lit("")), F.regexp_extract(F.coalesce("project", F.lit("")), "([^/]+)/*$", 1))
    return examples.select("example_id", *text, repo.alias("repo"))


def prompts(examples: DataFrame, least: int = 10) -> DataFrame:
    """Prompts of enough length without secrets."""
    t = F.trim("task_input")
    return examples.filter((F.length(t) >= least) & ~contains_secret(F.col("task_input"))).select("example_id", F.length(t).alias("size"))


def relevant(examples: DataFrame, text: str, name: str, body: str) -> DataFrame:
    """Examples that mention a skill's whole name, a name word of over 3 letters, or two of its body's keywords."""
    t = F.lower(text)
    plain_name = name.lower().replace("-", " ").replace("_", " ")
    hit = t.contains(plain_name)
    for w in plain_name.split():
        if len(w) > 3:
            hit = hit | t.contains(w)
    keys = sorted({k for w in body[:500].lower().split() if len(k := "".join(c for c in w if "a" <= c <= "z")) > 4})
    if keys:
        words = F.split(F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z\s]", ""), r"\s+", " ")), " ")
        hit = hit | (F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, keys)))) >= 2)
    return examples.filter(hit)


def first_of(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (null keys form one group)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def first_ids(rows: DataFrame, key: Column, id_col: str = "example_id") -> DataFrame:
    """Smallest id per key: an aggregation, for keys of any size."""
    return rows.groupBy(key.alias("key")).agg(F.min(id_col).alias(id_col))


def split_rank(split: Column) -> Column:
    out = F.lit(len(SPLIT_ORDER))
    for i, s in reversed(list(enumerate(SPLIT_ORDER))):
        out = F.when(split == s, i).otherwise(out)
    return out


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """(split, added): rows of ``new`` per split whose task is neither in ``old`` nor in an earlier split or row."""
    fresh = new.filter("task_input is not null").join(old.select("task_input").filter("task_input is not null").distinct(), "task_input", "left_anti")
    ranked = fresh.withColumn("split", lean("split")).withColumn("rank", split_rank(F.col("split"))).filter(F.col("rank") < len(SPLIT_ORDER))
    keep = ranked.groupBy("task_input").agg(F.min_by("split", F.struct("rank", "example_id")).alias("split"))
    return keep.groupBy("split").agg(F.count(F.lit(1)).alias("added"))


def ratio_split(examples: DataFrame, key: Column, train: float = 0.5, val: float = 0.25) -> DataFrame:
    """Examples in hash order cut at ratios: max(1, int(n r)) train, then the same for val, the rest holdout.

    The rank comes from a global order of md5 hashes, built in two steps (bucket offsets, then ranks within
    the bucket), so no task sorts everything.
    """
    h = examples.select("example_id", F.md5(key).alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = h.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    offsets = sizes.select("bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("n"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "example_id"))
    ranked = h.withColumn("place", place).join(offsets, "bucket").withColumn("place", F.col("place") + F.col("before"))
    a = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    b = a + F.greatest(F.lit(1), F.floor(F.col("n") * val))
    return ranked.select("example_id", F.when(F.col("place") <= a, "train").when(F.col("place") <= b, "val").otherwise("holdout").alias("split"))


def hash_split(examples: DataFrame, key: Column) -> DataFrame:
    """train, val or holdout by md5(key) modulo 3, from the hex digits: 16 is 1 modulo 3, so their sum decides."""
    digits = F.transform(F.split(F.md5(key), ""), lambda c: F.coalesce(F.conv(c, 16, 10).cast("int"), F.lit(0)))
    third = F.aggregate(digits, F.lit(0), lambda x, y: x + y) % 3
    return examples.select("example_id", F.when(third == 0, "train").when(third == 1, "val").otherwise("holdout").alias("split"))


def fill_up(matching: DataFrame, others: DataFrame, wanted: int) -> DataFrame:
    """``others`` beyond the matching ones in hash order, as many as are wanted (a sample)."""
    return others.join(matching.select("example_id"), "example_id", "left_anti").orderBy(F.md5(F.col("example_id").cast("string")), "example_id").limit(wanted)


def audit(examples: DataFrame, by: Column, stub_words: tuple[str, ...], prefix: int = 60) -> DataFrame:
    """Per group: examples, mean and upper-median task length, and the shares of stubs and of repeated prefixes."""
    t, e = F.lower(F.coalesce("task_input", F.lit(""))), F.lower(F.coalesce("expected_behavior", F.lit("")))
    stub = F.lit(False)
    for w in stub_words:
        stub = stub | t.contains(w) | e.contains(w)
    size = F.length(F.coalesce("task_input", F.lit("")))
    g = examples.groupBy(by.alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(size), 4).alias("mean_length"), F.expr("percentile_disc(0.5) within group (order by length(coalesce(task_input, '')) desc)").cast("int").alias("upper_median"),
        F.round(F.avg(stub.cast("double")), 6).alias("stub_share"), (F.count(F.lit(1)) - F.count_distinct(F.substring(t, 1, prefix))).alias("repeated"),
    )
    return g


def gaps(examples: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Per category and split how many examples are missing to the target; one row per category."""
    s = lean("split")
    category = F.coalesce(F.nullif(lean("category"), F.lit("")), F.lit("general"))
    return examples.groupBy(category.alias("category")).agg(*(F.greatest(F.lit(0), F.lit(n) - F.count_if(s == k)).alias(f"missing_{k}") for k, n in targets.items()))


def split_stats(examples: DataFrame) -> DataFrame:
    size = F.length(F.coalesce("task_input", F.lit(""))) + F.length(F.coalesce("expected_behavior", F.lit("")))
    return examples.groupBy(F.coalesce(lean("split"), F.lit("")).alias("split"), F.coalesce(lean("source"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(size), 4).alias("avg_chars"), F.count_if(F.coalesce(F.size("tool_sequence"), F.lit(0)) > 0).alias("with_tools"))


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def task_kinds(examples: DataFrame, kinds: dict[str, tuple[str, ...]] = TASK_KINDS) -> DataFrame:
    """The kind with most of its words in the task; earlier kinds win ties, none gives general."""
    t = F.lower(F.coalesce("task_input", F.lit("")))
    best = F.array_max(F.array(*(F.struct(keyword_hits(t, w).alias("hits"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, (k, w) in enumerate(kinds.items()))))
    return examples.select("example_id", F.when(best["hits"] == 0, "general").otherwise(best["kind"]).alias("kind"))


def topic_scores(examples: DataFrame, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """(example_id, topic, score): a third per word found, at most 1; topics without a hit are left out."""
    t = F.lower(F.concat_ws(" ", F.coalesce("task_input", F.lit("")), F.coalesce("expected_behavior", F.lit(""))))
    scores = F.array(*(F.struct(F.lit(k).alias("topic"), F.least(F.lit(1.0), keyword_hits(t, w) / 3.0).alias("score")) for k, w in topics.items()))
    return examples.select("example_id", F.explode(F.filter(scores, lambda x: x["score"] > 0)).alias("x")).select("example_id", "x.topic", F.round("x.score", 6).alias("score"))


def size_difficulty(examples: DataFrame) -> DataFrame:
    units = F.floor(F.length(F.coalesce("task_input", F.lit(""))) / 200)
    return examples.select("example_id", F.when(units > 10, "hard").when(units > 4, "medium").otherwise("easy").alias("difficulty"))


def background_noise(text: Column) -> Column:
    """Texts of scheduled jobs and of notices on finished background work."""
    t = F.lower(text)
    return F.substring(t, 1, 100).contains("scheduled cron job") | (t.startswith("[important") & t.contains("completed"))


def slug(text: Column, cut: int = 48) -> Column:
    """First heading or the text itself in kebab case, cut to ``cut`` characters."""
    title = F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), F.lit("")), text)
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, cut), "-+$", "")


def sampled(rows: DataFrame, key: str, per_10000: int) -> DataFrame:
    return rows.filter(hash_share(F.col(key), per_10000))


def audit_priority(examples: DataFrame, by: Column, stub_words: tuple[str, ...], prefix: int = 60) -> DataFrame:
    """Per group the counts that tell how badly its data need work, and their weighted sum (higher: more urgent).

    Deficits: training examples below ten, stubs and repeated beginnings in per cent, categories below five, no hard
    example. Difficulties and categories are counted without case; missing ones are a value of their own.
    """
    t, e = F.lower(F.coalesce("task_input", F.lit(""))), F.lower(F.coalesce("expected_behavior", F.lit("")))
    stub = F.lit(False)
    for w in stub_words:
        stub = stub | t.contains(w) | e.contains(w)
    g = examples.groupBy(by.alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lean("split") == "train").alias("train"), F.count_if(lean("difficulty") == "hard").alias("hard"), F.count_distinct(F.coalesce(lean("category"), F.lit(""))).alias("categories"),
        F.count_if(stub).alias("stubs"), (F.count(F.lit(1)) - F.count_distinct(F.substring(t, 1, prefix))).alias("repeated"),
    )
    score = F.greatest(F.lit(0), 10 - F.col("train")) * 2 + (F.col("stubs") + F.col("repeated")) * 150.0 / F.col("n") + F.greatest(F.lit(0), 5 - F.col("categories")) * 3 + F.when(F.col("hard") == 0, 3).otherwise(0)
    return g.withColumn("priority", F.round(score, 4))


def histogram(examples: DataFrame, by: Column, column: str) -> DataFrame:
    """(group, value, n): how often each value of a column occurs per group, without case and outer blanks."""
    return examples.groupBy(by.alias("group"), F.coalesce(lean(column), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def case_gate(examples: DataFrame, by: Column, least: dict[str, int]) -> DataFrame:
    """(group, <split>_cases, ok): whether every split of a group has as many examples as it needs."""
    s = lean("split")
    counts = examples.groupBy(by.alias("group")).agg(*(F.count_if(s == k).alias(f"{k}_cases") for k in least))
    ok = F.lit(True)
    for k, n in least.items():
        ok = ok & (F.col(f"{k}_cases") >= n)
    return counts.withColumn("ok", ok)
