"""Conversations rebuilt from message rows.

The rows are an event log: a create, edit, delete or retry of the message at a place (ordinal, else timestamp) of
a session. Folding by version leaves the final messages; these are ordered, given a speaker, and checked.

No step holds a session in one task: a session is cut into chunks of places, and what a chunk's rows need from
earlier ones (how many users and rows came before) is a running sum over chunk totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.ordering import running_sums
from tracelode.session import materialise

# Names under which the four speakers go, lower-cased, "-" and blanks as "_".
SPEAKERS = {
    "user": "user human person customer end_user enduser client prompter requester usr you question",
    "assistant": "assistant ai model agent bot gpt llm chatbot assistant_message ai_message gpt4 chatgpt assist answer",
    "system": "system developer sys system_message system_prompt instructions",
    "tool": "tool function tool_result tool_response tool_output tool_results function_call_output function_response function_result tool_message tool_return tool_use_result",
}
META = "session_meta"
#: Places of a session that one window looks at: ordinals, or seconds.
CHUNK = 10_000
BLANK = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200D\\u2028\\u2029\\u202F\\u205F\\u2060\\u3000\\uFEFF]"


def role_key(role: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(role, f"^{BLANK}+|{BLANK}+$", "")), "[-\\s]+", "_")


def speaker(role: Column) -> Column:
    """user, assistant, system, tool, session_meta, or null if the role names no speaker."""
    key, out = role_key(role), F.when(role_key(role) == META, F.lit(META))
    for name, aliases in SPEAKERS.items():
        out = out.when(key.isin(*aliases.split()), F.lit(name))
    return out


def instant(timestamp: Column) -> Column:
    """Microseconds of an ISO timestamp (without zone: UTC) or of epoch seconds or milliseconds; null if unreadable."""
    number = F.expr("try_cast(trim(__ts) as decimal(20, 6))")
    iso = F.expr("unix_micros(try_to_timestamp(replace(trim(__ts), ' ', 'T')))")
    from_number = F.when(number > 10**11, number * 1000).otherwise(number * 1_000_000).cast("bigint")
    return F.coalesce(from_number, iso)


def fold(rows: DataFrame) -> DataFrame:
    """Final messages of the log: (session_id, ordinal, at, place, message_id, role, speaker, content, tool_calls).

    rows: message_id (order of arrival), session_id, ordinal, role, content, tool_calls, timestamp, and perhaps
    ``event`` (create, edit, delete, retry; null is create). Rows equal in session, place, role and content are
    one create delivered again and count once, under the first id. An edit or retry replaces what stands at its place,
    a delete leaves a place without a message (as a session_meta row is). Sessions are compared without case and outer blanks; a null session is ''.
    """
    session = F.lower(F.regexp_replace(F.coalesce("session_id", F.lit("")), f"^{BLANK}+|{BLANK}+$", ""))
    given = rows.withColumn("__ts", F.col("timestamp"))
    at = instant(F.col("__ts"))
    kept = given.select(
        session.alias("session_key"), "session_id", "message_id", "ordinal", at.alias("at"), "role", speaker(F.col("role")).alias("speaker"), "content", "tool_calls",
        F.coalesce(F.col("ordinal").cast("bigint"), at).alias("place"), (F.lower("event") if "event" in rows.columns else F.lit("create")).alias("event"),
    )
    if "event" in rows.columns:
        of = Window.partitionBy("session_key", "place")
        last_change = F.max(F.when(F.col("event").isin("edit", "retry", "delete"), F.struct("message_id", "event"))).over(of)
        kept = kept.withColumn("last", last_change).filter(F.col("last").isNull() | (F.col("message_id") >= F.col("last.message_id"))).drop("last")
        gone = F.col("event") == "delete"
        kept = kept.withColumns({c: F.when(gone, F.lit(META if c != "content" else None)).otherwise(F.col(c)) for c in ("role", "speaker", "content")})
    # max: the copy with tool calls counts where a retry lost them
    first = F.min(F.struct("message_id", "session_id", "ordinal", "at", "role")).alias("f")
    by = [F.col("session_key"), F.col("place"), F.col("ordinal").isNull().alias("no_ordinal"), F.coalesce(F.col("speaker"), role_key(F.col("role")), F.lit("")).alias("as_role"), F.col("speaker"), F.col("content")]
    once = kept.groupBy(*by).agg(first, F.max("tool_calls").alias("tool_calls"))
    return once.select("session_key", "f.*", "place", "speaker", "content", "tool_calls")


def has_text(content: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(content, F.lit("")), f"{BLANK}+", "")) > 0


def _ordered(messages: DataFrame) -> DataFrame:
    """Adds ``turn`` (1, 2, ... over the session's messages; a session_meta row is none) and ``users`` (user
    messages up to and with this one), and ``ordinal_before``, the row's before it. Rows without a place come first,
    by arrival."""
    size = F.when(F.col("ordinal").isNotNull(), F.lit(CHUNK)).otherwise(F.lit(CHUNK * 1_000_000))
    who = F.coalesce("speaker", F.lit(""))
    sums = {"turn": (who != META).cast("bigint"), "users": (who == "user").cast("bigint")}
    unplaced = F.floor(F.coalesce("message_id", F.lit(0)) / CHUNK) - F.lit(1 << 61)
    chunk = F.when(F.col("place").isNull(), unplaced).otherwise(F.floor(F.col("place") / size))
    return running_sums(messages, ["session_key"], chunk, ["place", "message_id"], sums, {"ordinal_before": F.col("ordinal")})


def session_defects(ordered: DataFrame) -> DataFrame:
    """(session_key, session_id, defect) of every session; defect is null for a sound one.

    The first that applies: empty (no user or assistant message has any text), broken (a role names no speaker;
    given ordinals are not 0, 1, 2, ... over all rows; an assistant message before the first user message; a
    tool message without an assistant message with tool calls since the last user message), missing_reply (a
    user message without an assistant message with text before the next one or the end). A session without user
    messages that has an assistant message is broken.
    """
    who, text = F.coalesce("speaker", F.lit("")), has_text(F.col("content"))
    calls = (who == "assistant") & (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0)
    segments = ordered.groupBy("session_key", "users").agg(
        F.min("session_id").alias("session_id"), F.count(F.lit(1)).alias("k"), F.count("ordinal").alias("numbered"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"),
        F.max((F.col("ordinal") == F.col("ordinal_before")).cast("int")).alias("again"),
        F.max((who.isin("user", "assistant") & text).cast("int")).alias("said"), F.max(F.col("speaker").isNull().cast("int")).alias("nobody"),
        F.max((who == "assistant").cast("int")).alias("assistant"), F.max(((who == "assistant") & text).cast("int")).alias("replied"),
        F.min(F.when(calls, F.col("turn"))).alias("first_call"), F.min(F.when(who == "tool", F.col("turn"))).alias("first_tool"),
    )
    tool_alone = F.col("first_tool").isNotNull() & (F.col("first_call").isNull() | (F.col("first_call") > F.col("first_tool")))
    sessions = segments.groupBy("session_key").agg(
        F.min("session_id").alias("session_id"), F.sum("k").alias("k"), F.sum("numbered").alias("numbered"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("again").alias("again"),
        F.max("said").alias("said"), F.max("nobody").alias("nobody"), F.max(F.when(F.col("users") == 0, F.col("assistant"))).alias("too_early"), F.max(tool_alone.cast("int")).alias("tool_alone"),
        F.max(((F.col("users") > 0) & (F.col("replied") == 0)).cast("int")).alias("no_reply"),
    )
    # k ordinals within 0 .. k - 1, none of them twice (equal ones are neighbours in a session that has them all)
    in_order = (F.col("numbered") == F.col("k")) & (F.col("lo") == 0) & (F.col("hi") == F.col("k") - 1) & (F.coalesce("again", F.lit(0)) == 0)
    broken = (F.col("nobody") == 1) | ((F.col("numbered") > 0) & ~F.coalesce(in_order, F.lit(False))) | (F.coalesce("too_early", F.lit(0)) == 1) | (F.col("tool_alone") == 1)
    defect = F.when(F.col("said") == 0, "empty").when(broken, "broken").when(F.col("no_reply") == 1, "missing_reply")
    return sessions.select("session_key", "session_id", defect.alias("defect"))


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered messages with their speakers, defects of all sessions)."""
    ordered = materialise(_ordered(fold(rows)), "ordered")
    return ordered, session_defects(ordered)


def left_out(rows: DataFrame) -> DataFrame:
    """(session_id, defect) of the sessions that are no sound conversation. An empty table gives none."""
    return rebuild(rows)[1].filter("defect is not null").select("session_id", "defect")


def conversations(rows: DataFrame) -> DataFrame:
    """(session_id, turn, speaker, content, tool_calls) of the sound sessions' messages, numbered from 1."""
    ordered, defects = rebuild(rows)
    sound = defects.filter("defect is null").select("session_key", F.col("session_id").alias("id"))
    kept = ordered.join(sound, "session_key")
    return kept.filter(F.col("speaker") != META).select(F.col("id").alias("session_id"), "turn", "speaker", "content", "tool_calls")
