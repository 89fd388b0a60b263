"""Agent traces as message rows: turn pairs, tool requests, session counts, outcomes and failure classes.

Rows are (session_id, ordinal, message_id, role, content, tool_calls, ...); a row without ordinal is ordered by
its message_id. Keyword lists are parameters with the usual values as defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.ordering import running_sums

# Keyword lists of the outcome and failure rules.
SUCCESS_WORDS = ("done", "completed", "finished", "accomplished", "deployed", "saved", "written", "created", "fixed", "resolved", "succeeded", "thank you", "perfect", "excellent", "great work")
FAILURE_WORDS = (
    "no that's wrong", "not correct", "that's wrong", "try again", "don't do that", "stop", "cancel", "wait", "actually", "failed", "error", "didn't work", "doesn't work",
    "no improvement", "still broken", "reverted", "rolled back", "that's not what i asked", "not what i wanted",
)
#: How many of the failure words mark a user's correction.
CORRECTIONS = 8
HEDGES = ("option", "could", "might", "consider")
ACTIONS = ("check", "verify", "inspect", "look", "examine", "run", "execute")
STALE_MARKS = ("deprecated", "no longer", "outdated", "old version", "previous approach", "legacy")
STRUCTURE_NAMES = ("task_input", "expected_behavior", "difficulty", "category")


def messages(rows: DataFrame) -> DataFrame:
    """Speaking rows with a plain role and an ``ord``; rows of other roles are left out."""
    role = F.lower(F.trim("role"))
    speaker = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai", "model", "agent"), "assistant").when(role.isin("tool", "function", "tool_result"), "tool").when(role.isin("system", "developer"), "system")
    ord_ = F.coalesce(F.col("ordinal").cast("bigint"), F.col("message_id"))
    return rows.select("session_id", ord_.alias("ord"), "message_id", speaker.alias("role"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("tool_calls", F.array().cast("array<string>")).alias("tool_calls"), "source", "project").filter("role is not null")


#: Places of a session whose rows are windowed together.
CHUNK = 10_000


def with_turns(msgs: DataFrame) -> DataFrame:
    """Adds ``turn``: the number of user rows up to and with this one. A session of any size is cut into chunks."""
    turn = {"turn": (F.col("role") == "user").cast("bigint")}
    return running_sums(msgs, ["session_id"], F.floor(F.col("ord") / CHUNK), [F.col("ord"), F.col("message_id")], turn)


def turn_pairs(rows: DataFrame, least: int = 1) -> DataFrame:
    """Each user row of ``least`` characters with the next non-empty assistant text before the next user row.

    A missing answer stays as ''. The turns are numbered, one aggregation pairs them; no range join.
    """
    t = with_turns(messages(rows)).filter("turn > 0")
    place = F.struct("ord", "message_id")
    answer = (F.col("role") == "assistant") & (F.trim("content") != "")
    g = t.groupBy("session_id", "turn").agg(
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("task_input"), F.coalesce(F.min_by("content", F.when(answer, place)), F.lit("")).alias("response"), F.count_if(answer).alias("answers")
    )
    return g.filter(F.length("task_input") >= least)


def joined_pairs(rows: DataFrame, secret: Column | None = None, least: int = 10) -> DataFrame:
    """Each user row with all assistant texts of its turn, joined by line breaks; both sides must have text.

    secret: a condition on ``task_input`` and ``response`` that drops the pair.
    """
    t = with_turns(messages(rows)).filter("turn > 0 and trim(content) <> '' and role in ('user', 'assistant')")
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("ord", "message_id", "content")))), lambda x: x["content"])
    g = t.groupBy("session_id", "turn").agg(F.max(F.when(F.col("role") == "user", F.col("content"))).alias("task_input"), F.array_join(texts, "\n").alias("response"))
    g = g.filter((F.length("task_input") >= least) & (F.col("response") != ""))
    return g.filter(~secret) if secret is not None else g


def tool_requests(rows: DataFrame, cut: int = 200) -> DataFrame:
    """Each assistant tool call with the nearest user text before it, cut to ``cut`` characters."""
    t = with_turns(messages(rows)).filter("turn > 0")
    said = t.filter("role = 'user'").select("session_id", "turn", F.substring("content", 1, cut).alias("task"))
    calls = t.filter("role = 'assistant'").select("session_id", "turn", "message_id", F.posexplode("tool_calls").alias("call_no", "tool_name"))
    return calls.join(said, ["session_id", "turn"]).select("session_id", "message_id", "call_no", "tool_name", "task")


def tool_sequences(rows: DataFrame, least: int = 3) -> DataFrame:
    """Per session the tools in order of first use, the number of calls, and whether there are at least ``least``."""
    calls = messages(rows).filter("role = 'assistant'").select("session_id", "ord", "message_id", F.posexplode("tool_calls").alias("k", "tool"))
    first = calls.groupBy("session_id", "tool").agg(F.min(F.struct("ord", "message_id", "k")).alias("at"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "tool"))), lambda x: x["tool"])
    return first.groupBy("session_id").agg(F.array_join(ordered, ",").alias("tools"), F.sum("n").alias("calls"), (F.sum("n") >= least).alias("capturable"))


def session_counts(rows: DataFrame, cut: int = 300) -> DataFrame:
    place = F.struct("ord", "message_id")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return messages(rows).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(user).alias("users"), F.count_if(assistant).alias("assistants"),
        F.substring(F.coalesce(F.min_by("content", F.when(user, place)), F.lit("")), 1, cut).alias("first_user"), F.substring(F.coalesce(F.max_by("content", F.when(assistant, place)), F.lit("")), 1, cut).alias("last_assistant"),
    )


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def outcomes(rows: DataFrame, success: tuple[str, ...] = SUCCESS_WORDS, failure: tuple[str, ...] = FAILURE_WORDS, corrections: int = CORRECTIONS) -> DataFrame:
    """Per session how many success and failure words occur, how many user rows correct, and the outcome.

    A word that spans two messages does not count. No session's text is put together: words are flagged per row
    and the flags are merged.
    """
    text = F.lower("content")
    some = messages(rows).select(
        "session_id", F.length("content").alias("size"), *(text.contains(w).alias(f"s{i}") for i, w in enumerate(success)), *(text.contains(w).alias(f"f{i}") for i, w in enumerate(failure)),
        ((F.col("role") == "user") & has_any(text, failure[:corrections])).alias("corrects"),
    )
    count = lambda letter, words: sum(F.max(F.col(f"{letter}{i}").cast("int")) for i in range(len(words)))
    m = some.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("size").alias("chars"), count("s", success).alias("successes"), count("f", failure).alias("failures"), F.count_if("corrects").alias("corrections"))
    s, f, c = F.col("successes"), F.col("failures"), F.col("corrections")
    outcome = F.when((f > s) & (c > 1), "failed").when((s > f) & (c == 0), "succeeded").when(c > 0, "partial").otherwise("unknown")
    return m.withColumn("outcome", outcome)


def good_examples(sessions: DataFrame, least_messages: int = 6, least_chars: int = 1000) -> DataFrame:
    """Sessions (of outcomes()) worth an evaluation example: a clear success of enough substance."""
    return sessions.filter((F.col("outcome") == "succeeded") & (F.col("messages") >= least_messages) & (F.col("chars") > least_chars))


def outcome_shares(sessions: DataFrame) -> DataFrame:
    m = sessions.groupBy("outcome").agg(F.count(F.lit(1)).alias("sessions"))
    return m.withColumn("percent", F.round(100.0 * F.col("sessions") / F.sum("sessions").over(Window.partitionBy(F.lit(0))), 4))


def failures(rows: DataFrame, hedges=HEDGES, actions=ACTIONS, stale=STALE_MARKS, structure=STRUCTURE_NAMES, skill: str = "skill", option: str = "option", long: int = 500, described: int = 200, drift: int = 100) -> DataFrame:
    """(session_id, failure_class, hits): the failure classes of each session, in one pass over its messages.

    long_briefing: an assistant text over ``long`` characters that hedges and offers two options or more than
    ten lines. raw_dump: user rows, but no assistant text with a structured field name. tool_underuse: assistant
    texts over ``described`` characters without tool calls that speak of acting. skill_drift: assistant texts
    over ``drift`` characters on a skill with a mark of staleness.
    """
    text, size = F.lower("content"), F.length("content")
    assistant = F.col("role") == "assistant"
    options = F.regexp_count(text, F.lit(option))
    lines = F.regexp_count("content", F.lit("\n")) + 1
    m = messages(rows).groupBy("session_id").agg(
        F.count_if(assistant & (size > long) & has_any(text, hedges) & ((options >= 2) | (lines > 10))).alias("long_briefing"),
        F.when(~F.coalesce(F.bool_or(assistant & has_any(text, structure)), F.lit(False)), F.count_if(F.col("role") == "user")).otherwise(0).alias("raw_dump"),
        F.count_if(assistant & (F.size("tool_calls") == 0) & (size > described) & has_any(text, actions)).alias("tool_underuse"),
        F.count_if(assistant & text.contains(skill) & (size > drift) & has_any(text, stale)).alias("skill_drift"),
    )
    long_form = m.unpivot(["session_id"], ["long_briefing", "raw_dump", "tool_underuse", "skill_drift"], "failure_class", "hits")
    return long_form.filter("hits > 0").select("session_id", "failure_class", F.col("hits").cast("bigint").alias("hits"))


def action_items(found: DataFrame, templates: DataFrame) -> DataFrame:
    """One item per session and failure class with its template; classes without one are dropped (inner join)."""
    key = F.substring(F.sha2(F.concat_ws(":", "session_id", "failure_class"), 256), 1, 16)
    return found.join(templates, "failure_class").select("session_id", "failure_class", "title", key.alias("dedupe_key"))


def trace_rows(rows: DataFrame, reasoning_cut: int = 500, output_cut: int = 200, keys: tuple[str, ...] = ("exit_code", "status", "error")) -> DataFrame:
    """Trace rows with reasoning cut short and tool output reduced to a few keys, cut short; meta rows dropped."""
    out = [F.substring(F.try_element_at("output_summary", F.lit(k)), 1, output_cut).alias(k) for k in keys]
    return rows.filter(F.coalesce(F.lower(F.trim("role")), F.lit("")) != "session_meta").select("message_id", "session_id", F.substring("reasoning", 1, reasoning_cut).alias("reasoning"), *out)


def carried_forward(rows: DataFrame, mark: Column, value: Column, by: str, order: list[str]) -> Column:
    """The last value of a marked row up to this one (a heading over the lines below it)."""
    return F.last(F.when(mark, value), ignorenulls=True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
