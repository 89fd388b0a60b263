"""Rebuilding conversations: order, speakers, repeats, each defect, edits and deletes."""

from tracelode.llm import conversations as C

SCHEMA = "message_id bigint, session_id string, ordinal int, role string, content string, tool_calls array<string>, timestamp string, turn int, speaker string"


def table(spark, rows):
    return spark.createDataFrame([(i, s, o, r, c, t, at, 7, "clash") for i, (s, o, r, c, t, at) in enumerate(rows)], SCHEMA)


GOOD = [("g", 2, "AI", "hello", None, None), ("g", 0, "session_meta", "{}", None, None), ("g", 1, "Human ", "hi", None, None), ("g", 1, "human", "hi", None, "x")]
TOOLS = [("t", 0, "user", "do", None, None), ("t", 1, "assistant", None, ["run"], None), ("t", 2, "tool_result", "ok", None, None), ("t", 3, "assistant", "done", [], None)]
TIMED = [("c", None, "assistant", "yes", None, "2025-01-01T02:00:05+02:00"), ("c", None, "user", "well?", None, "2025-01-01T00:00:04Z"), ("c", None, "user", "well?", None, "2025-01-01T01:00:04+01:00")]
BAD = [
    ("e1", 0, "user", " ", None, None), ("e1", 1, "assistant", None, ["x"], None), ("b1", 0, "user", "q", None, None), ("b1", 2, "assistant", "a", None, None), ("b2", 0, "assistant", "a", None, None), ("b2", 1, "user", "q", None, None), ("b2", 2, "assistant", "a", None, None),
    ("b3", 0, "user", "q", None, None), ("b3", 1, "tool", "x", None, None), ("b3", 2, "assistant", "a", None, None), ("b4", 0, "user", "q", None, None), ("b4", 1, "wizard", "a", None, None), ("b5", 0, "user", "q", None, None), ("b5", 1, None, "a", None, None), ("b6", 0, "user", "q", None, None), ("b6", 0, "user", "p", None, None),
    ("m1", 0, "user", "q", None, None), ("m1", 1, "user", "p", None, None), ("m1", 2, "assistant", "a", None, None), ("m2", 0, "user", "q", None, None), ("m2", 1, "assistant", "a", None, None), ("m2", 2, "user", "p", None, None), ("m2", 3, "assistant", "", ["x"], None),
]


def test_defects(spark):
    got = {r.session_id: r.defect for r in C.left_out(table(spark, GOOD + TOOLS + TIMED + BAD)).collect()}
    assert got == {"e1": "empty", **{f"b{i}": "broken" for i in range(1, 7)}, "m1": "missing_reply", "m2": "missing_reply"}


def test_ordinals_with_the_sums_of_a_sound_session(spark):
    who = ["user", "assistant"] * 4
    rows = [("s", o, w, f"x{i}", None, None) for i, (o, w) in enumerate(zip((0, 0, 3, 4, 4, 5, 5, 7), who))]
    assert [r.defect for r in C.left_out(table(spark, rows)).collect()] == ["broken"]
    assert C.conversations(table(spark, rows)).count() == 0


def test_rows_without_a_place_are_ordered_by_arrival(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 3)
    rows = [("s", None, w, f"x{i}", None, None) for i, w in enumerate(["user", "assistant"] * 5)]
    assert [r.content for r in C.conversations(table(spark, rows)).orderBy("turn").collect()] == [f"x{i}" for i in range(10)]


def test_conversations(spark):
    got = sorted((r.session_id, r.turn, r.speaker, r.content) for r in C.conversations(table(spark, GOOD + TOOLS + TIMED + BAD)).collect())
    assert got == [
        ("c", 1, "user", "well?"), ("c", 2, "assistant", "yes"), ("g", 1, "user", "hi"), ("g", 2, "assistant", "hello"), ("t", 1, "user", "do"), ("t", 2, "assistant", None), ("t", 3, "tool", "ok"), ("t", 4, "assistant", "done"),
    ]


def test_long_session_crosses_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 3)
    rows = [("s", i, "user" if i % 2 == 0 else "assistant", f"x{i}", None, None) for i in range(20)]
    assert C.left_out(table(spark, rows)).count() == 0
    assert [r.content for r in C.conversations(table(spark, rows)).orderBy("turn").collect()] == [f"x{i}" for i in range(20)]
    rows[7] = ("s", 7, "assistant", " ", None, None)
    assert [r.defect for r in C.left_out(table(spark, rows)).collect()] == ["missing_reply"]


def test_edits_and_deletes(spark):
    rows = [(1, "s", 0, "user", "q", "create"), (2, "s", 1, "assistant", "draft", None), (3, "s", 1, "assistant", "final", "edit"), (4, "s", 2, "user", "oops", "create"), (5, "s", 2, "user", None, "delete"), (6, "s", 3, "user", "p", None), (7, "s", 4, "assistant", "bad", None), (8, "s", 4, "assistant", "good", "retry")]
    df = spark.createDataFrame([(i, s, o, r, c, None, None, e) for i, s, o, r, c, e in rows], "message_id bigint, session_id string, ordinal int, role string, content string, tool_calls array<string>, timestamp string, event string")
    assert [(r.turn, r.content) for r in C.conversations(df).orderBy("turn").collect()] == [(1, "q"), (2, "final"), (3, "p"), (4, "good")]


def test_empty_and_null_session(spark):
    assert C.left_out(table(spark, [])).count() == 0 and C.conversations(table(spark, [])).count() == 0
    assert [tuple(r) for r in C.left_out(table(spark, [(None, 0, "user", "q", None, None)])).collect()] == [(None, "missing_reply")]
