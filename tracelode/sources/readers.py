"""Readers for the files that evaluation data, traces and runs come in. All read with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators.datasets import contains_secret, ratio_split

EXAMPLE = (
    "task_input string, expected_behavior string, expected_output string, difficulty string, category string, source string, tool_sequence array<string>, complexity_score int, "
    "session_id string, success_pattern string, project string, repo string, timestamp string, message_role string, extraction_reason string"
)
RUN = "run_id string, skill_name string, skill string, timestamp string, baseline_score double, best_score double, evolved_score double, improvement double, elapsed_seconds double, constraints_passed boolean, optimizer_type string, eval_source string, iterations int"
CARD = "title string, status string, priority string, best_delta double, age_hours double, eval_source string, is_multi_run boolean"
SPLITS = ("train", "val", "holdout")


def _file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def _examples(rows: DataFrame) -> DataFrame:
    """Missing fields get their defaults; an answer under its older name counts."""
    return rows.withColumn("expected_behavior", F.coalesce("expected_behavior", "expected_output")).drop("expected_output").fillna({"difficulty": "medium", "category": "general", "source": "synthetic"})


def read_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples of <folder>/{train,val,holdout}.jsonl with their split; a missing file is an empty split.

    Unknown fields are dropped, unreadable and blank lines too.
    """
    rows = spark.read.schema(EXAMPLE).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(folder).withColumn("split", _file())
    return _examples(rows.filter(F.col("split").isin(*SPLITS))).filter("task_input is not null")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """One file of examples, split 50/25/25 in hash order of the tasks."""
    rows = _examples(spark.read.schema(EXAMPLE).option("mode", "DROPMALFORMED").json(path)).filter("task_input is not null").withColumn("example_id", F.md5(F.concat_ws("\n", "task_input", "expected_behavior")))
    return rows.join(ratio_split(rows, F.col("task_input")), "example_id")


def read_prompt_history(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Prompt lines {display, timestamp, project, sessionId}: no malformed, short or secret-bearing ones."""
    rows = spark.read.text(path).select(F.from_json("value", "display string, timestamp bigint, project string, sessionId string").alias("r")).filter("r.display is not null")
    keep = (F.length(F.trim("r.display")) >= least) & ~contains_secret(F.col("r.display"))
    return rows.filter(keep).select(F.trim("r.display").alias("task_input"), F.timestamp_millis("r.timestamp").alias("at"), F.col("r.project").alias("project"), F.col("r.sessionId").alias("session_id"))


def read_event_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Message rows of event files in one directory per session, with the directory a session worked in."""
    session = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder)
    rows = rows.select(session.alias("session_id"), F.from_json("value", "type string, timestamp string, data struct<content: string>").alias("e"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    role = F.when(F.col("e.type") == "user.message", "user").when(F.col("e.type") == "assistant.message", "assistant")
    order = Window.partitionBy("session_id").orderBy("block", "line")
    msgs = rows.withColumn("role", role).filter("role is not null").select("session_id", (F.row_number().over(order) - 1).alias("ordinal"), "role", F.col("e.data.content").alias("content"))
    places = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    places = places.select(session.alias("session_id"), F.trim(F.regexp_extract("value", r"(?m)^cwd:(.*)$", 1)).alias("project"))
    return msgs.join(places, "session_id", "left")


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Message rows of JSON sessions {session_id, messages: [...]}, one file each."""
    rows = spark.read.schema("session_id string, messages array<struct<role: string, content: string>>").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("at", F.col("_metadata.file_modification_time")).select("session_id", "at", F.posexplode("messages").alias("ordinal", "m")).select("session_id", "at", "ordinal", "m.role", "m.content")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Message rows of JSONL traces; a session_meta row names the session and is dropped, reasoning is cut to 500,
    tool calls become names, tool output keeps exit_code, status and error cut to 200. Bad lines are dropped."""
    shape = "role string, content string, session_id string, reasoning string, reasoning_content string, tool_calls array<struct<function: struct<name: string>>>"
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.from_json("value", shape).alias("m")).filter("m.role is not null")
    named = rows.groupBy("file").agg(F.max(F.when(F.col("m.role") == "session_meta", F.coalesce("m.session_id", F.get_json_object("m.content", "$.session_id")))).alias("session_id"))
    out = F.map_filter(F.from_json("m.content", "map<string,string>"), lambda k, v: k.isin("exit_code", "status", "error"))
    order = Window.partitionBy("file").orderBy("line")
    kept = rows.filter("m.role <> 'session_meta'").withColumn("ordinal", F.row_number().over(order) - 1).join(named, "file", "left")
    return kept.select(
        F.coalesce("session_id", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("session_id"), "ordinal", "m.role", F.coalesce("m.content", F.lit("")).alias("content"),
        F.substring(F.coalesce("m.reasoning", "m.reasoning_content"), 1, 500).alias("reasoning"), F.transform("m.tool_calls", lambda c: c["function"]["name"]).alias("tool_calls"),
        F.when(F.col("m.role") == "tool", F.transform_values(out, lambda k, v: F.substring(v, 1, 200))).alias("output_summary"),
    )


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of both report layouts under one set of names; a run found in both counts once."""
    rows = spark.read.schema(RUN).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "{metrics,report}.json").json(folder)
    path = F.split(F.col("_metadata.file_path"), "/")
    rows = rows.select(
        F.coalesce("run_id", F.element_at(path, -2)).alias("run_id"), F.coalesce("skill", "skill_name", F.element_at(path, -3)).alias("skill"), "baseline_score",
        F.coalesce("evolved_score", "best_score").alias("evolved_score"), "improvement", "elapsed_seconds", "constraints_passed", "optimizer_type", "eval_source", "iterations", F.element_at(path, -1).alias("file"),
    )
    first = Window.partitionBy("skill", "run_id").orderBy(F.desc("file"))
    return rows.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "file")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Run statistics by header name, whatever the columns' number and order; scores as numbers."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(*(F.expr(f"try_cast(`{c}` as double)").alias(c) if c.endswith(("score", "improvement", "seconds", "pct")) else F.col(f"`{c}`") for c in rows.columns))


def read_cards(spark: SparkSession, path: str, stale_after: float = 168) -> DataFrame:
    rows = spark.read.schema(CARD).option("multiLine", "true").json(path)
    return rows.withColumn("is_stale", F.coalesce(F.col("age_hours") > stale_after, F.lit(False)))


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """(column, title) of the ``- title`` lines of a Markdown board under their ``## column`` heading."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^##\s+([\w ]+?)\s*$", 1)
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("column", F.last(F.when(head != "", head), ignorenulls=True).over(upto)).withColumn("title", F.trim(F.regexp_extract("line", r"^[-*]\s+(?:\[.\]\s+)?(.*)$", 1)))
    return held.filter("title <> '' and column is not null").select("column", "title")


def read_candidates(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    shape = "session_id string, task string, skill_body string, captured_at string, status string, domain_tags array<string>, overlapping_skills array<string>, tool_sequence array<string>, total_tool_calls int, success_pattern string"
    rows = spark.read.schema(shape).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.filter(F.col("status") == status) if status else rows
    return rows.select("session_id", "task", "status", F.length("skill_body").alias("body_chars"), F.coalesce(F.size("domain_tags"), F.lit(0)).alias("tags"), F.coalesce(F.size("overlapping_skills"), F.lit(0)).alias("overlaps"))


def read_skills(spark: SparkSession, folder: str, least: int = 0, most: int = 2**31 - 1) -> DataFrame:
    """(path, text) of the Markdown skill files within a band of sizes in characters, in path order.

    Files of fewer bytes than ``least``, or more than four times ``most``, are not read at all.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = rows.filter(F.col("_metadata.file_size").between(least, 4 * most))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(F.length("text").between(least, most)).orderBy("path")


def find_skill(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path, text) of the skills of that name: the folder's or file's, else the ``name:`` of the front matter."""
    skills = read_skills(spark, folder)
    parts = F.split("path", "/")
    at_path = F.lit(name).isin(F.element_at(parts, -2), F.regexp_replace(F.element_at(parts, -1), r"\.md$", ""))
    return skills.filter(at_path | (T.front_matter_field(F.col("text"), "name") == name)).orderBy(~at_path, "path")


def source_counts(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Rows per named source, 0 for one without rows."""
    named = rows.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return named.join(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").fillna(0, ["n"])


def from_templates(spark: SparkSession, templates: DataFrame, tools: DataFrame, slots: dict[str, str], per_tool: int) -> DataFrame:
    """Tasks of templates (template_id, tool, text) whose tool is known, ``{slot}`` filled in, ``per_tool`` each."""
    rank = F.row_number().over(Window.partitionBy("tool").orderBy("template_id"))
    text = F.col("text")
    for k, v in slots.items():
        text = F.replace(text, F.lit("{" + k + "}"), F.lit(v))
    return templates.join(tools, "tool").withColumn("rank", rank).filter(F.col("rank") <= per_tool).select("tool", text.alias("task"), F.when(F.col("rank") <= 2, "easy").otherwise("medium").alias("difficulty"))


def descriptions(spark: SparkSession, document: str) -> DataFrame:
    """(name, description) of a JSON object of descriptions."""
    one = spark.createDataFrame([(document,)], "doc string")
    return one.select(F.explode(F.from_json("doc", "map<string,string>")).alias("name", "description"))
