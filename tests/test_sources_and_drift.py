"""Readers and writers on files, schema drift on planted changes, streaming with late rows."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tracelode.operators import schema_drift
from tracelode.sources import readers, sinks
from tracelode.streaming import windows


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_examples(spark, tmp_path):
    write(tmp_path / "train.jsonl", [{"task_input": "a", "expected_output": "b", "unknown": 1}, "", "{broken"])
    write(tmp_path / "val.jsonl", [{"task_input": "c", "expected_behavior": "d", "difficulty": "hard"}])
    got = {r.task_input: r for r in readers.read_examples(spark, str(tmp_path)).collect()}
    assert got["a"].split == "train" and got["a"].expected_behavior == "b" and got["a"].difficulty == "medium" and got["c"].split == "val" and len(got) == 2
    sinks.write_splits(spark.createDataFrame([("t", "train"), ("v", "val")], "task_input string, split string"), str(tmp_path / "out"))
    assert {r.split for r in spark.read.json(str(tmp_path / "out")).collect()} == {"train", "val"}
    write(tmp_path / "golden.jsonl", [{"task_input": f"t{i}", "expected_behavior": "x"} for i in range(8)])
    assert {r.split: r["count"] for r in readers.read_golden(spark, str(tmp_path / "golden.jsonl")).groupBy("split").count().collect()} == {"train": 4, "val": 2, "holdout": 2}


def test_traces_and_histories(spark, tmp_path):
    write(tmp_path / "h.jsonl", [{"display": "a long prompt", "timestamp": 1700000000000, "project": "/p", "sessionId": "s"}, {"display": "short"}, "{", {"display": "password = x y z w"}])
    assert [r.task_input for r in readers.read_prompt_history(spark, str(tmp_path / "h.jsonl")).collect()] == ["a long prompt"]
    write(tmp_path / "t" / "x.jsonl", [{"role": "session_meta", "session_id": "S9"}, {"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [{"function": {"name": "run"}}], "reasoning": "r" * 600}, {"role": "tool", "content": json.dumps({"exit_code": "0", "other": "y"})}, "bad"])
    got = readers.read_traces(spark, str(tmp_path / "t")).orderBy("ordinal").collect()
    assert [(r.session_id, r.role) for r in got] == [("S9", "user"), ("S9", "assistant"), ("S9", "tool")] and got[1].tool_calls == ["run"] and len(got[1].reasoning) == 500 and got[2].output_summary == {"exit_code": "0"}
    write(tmp_path / "e" / "s1" / "events.jsonl", [{"type": "session.start"}, {"type": "user.message", "data": {"content": "q"}}, {"type": "assistant.message", "data": {"content": "a"}}])
    write(tmp_path / "e" / "s1" / "workspace.yaml", ["id: 1", "cwd: /home/x"])
    assert [(r.session_id, r.ordinal, r.role, r.project) for r in readers.read_event_streams(spark, str(tmp_path / "e")).orderBy("ordinal").collect()] == [("s1", 0, "user", "/home/x"), ("s1", 1, "assistant", "/home/x")]
    write(tmp_path / "j" / "a.json", [{"session_id": "z", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}])
    assert readers.read_sessions(spark, str(tmp_path / "j")).count() == 2


def test_runs_boards_and_others(spark, tmp_path):
    write(tmp_path / "r" / "skill" / "v2_1" / "report.json", [{"skill_name": "skill", "best_score": 0.6, "baseline_score": 0.5}])
    write(tmp_path / "r" / "skill" / "v2_1" / "metrics.json", [{"skill_name": "skill", "evolved_score": 0.7}])
    write(tmp_path / "r" / "skill" / "2" / "metrics.json", [{"evolved_score": 0.8}])
    assert {(r.run_id, r.skill, r.evolved_score) for r in readers.read_runs(spark, str(tmp_path / "r")).collect()} == {("v2_1", "skill", 0.6), ("2", "skill", 0.8)}
    write(tmp_path / "b.md", ["# Board", "## In progress", "- [x] one", "text", "## Done", "* two"])
    assert [tuple(r) for r in readers.read_board(spark, str(tmp_path / "b.md")).collect()] == [("In progress", "one"), ("Done", "two")]
    write(tmp_path / "s.csv", ["skill,baseline_score,note", "a,0.5,x", "b,,y"])
    assert [r.baseline_score for r in readers.read_stats(spark, str(tmp_path / "s.csv")).orderBy("skill").collect()] == [0.5, None]
    write(tmp_path / "k" / "a.md", ["# A"])
    write(tmp_path / "k" / "b" / "c.md", ["---", "name: other", "---", "body of it"])
    assert readers.read_skills(spark, str(tmp_path / "k"), 1, 10).count() == 1
    assert [r.path[-4:] for r in readers.read_skills(spark, str(tmp_path / "k")).collect()] == ["a.md", "c.md"]
    assert [[r.path[-4:] for r in readers.find_skill(spark, str(tmp_path / "k"), n).collect()] for n in ("a", "b", "other", "no")] == [["a.md"], ["c.md"], ["c.md"], []]
    assert [tuple(r) for r in readers.descriptions(spark, '{"a": "x"}').collect()] == [("a", "x")]
    tasks = readers.from_templates(spark, spark.createDataFrame([(1, "t", "do {x}"), (2, "u", "no")], "template_id int, tool string, text string"), spark.createDataFrame([("t",)], "tool string"), {"x": "it"}, 2)
    assert [tuple(r) for r in tasks.collect()] == [("t", "do it", "easy")]
    assert sinks.board(spark.createDataFrame([("B", "y"), ("A", "x")], "c string, t string"), "c", "t") == "## A\n\n- x\n\n## B\n\n- y"
    r = json.loads(sinks.report_json(spark.createDataFrame([("n", "é", "b")], "name string, old string, new string"), "old", "new").first()[0])
    assert r["bytes_before"] == 2 and r["name"] == "n" and len(r["hash_after"]) == 64


RAW = "file_name string, stream string, written_at timestamp, line_no int, payload string, path string, sums int"


def exported(spark, files):
    rows = []
    for k, (stream, records) in enumerate(files):
        for i, r in enumerate(records):
            rows.append((f"{stream}/{k}", stream, datetime(2025, 1, 1 + k), i, r if isinstance(r, str) or r is None else json.dumps(r), "clash", 1))
    return spark.createDataFrame(rows + rows[:1], RAW)


def test_planted_changes(spark):
    texts = [f"open the card {i} and close the gate of harbor {i}" for i in range(8)]
    base = [{"task": t, "score": 0.1 * i, "level": ["easy", "hard"][i % 2], "meta": {"why": "picked by hand"}, "gone": None} for i, t in enumerate(texts)]
    moved = [{"prompt": r["task"], "score": str(r["score"]), "level": r["level"], "why": r["meta"]["why"], "tools": ["run"]} for r in base]
    less = [{k: v for k, v in r.items() if k != "level"} for r in moved] + ["{unreadable", "[1]", None]
    lines = exported(spark, [("eval/a", base), ("eval/a", moved), ("eval/a", less), ("eval/b", base)])
    got = {tuple(r) for r in schema_drift.schema_changes(lines).collect()}
    assert got == {("eval/a/1", "renamed", "task", "prompt"), ("eval/a/1", "renamed", "meta.why", "why"), ("eval/a/1", "retyped", "score", ""), ("eval/a/1", "added", "tools", ""), ("eval/a/2", "removed", "level", "")}
    t = schema_drift.consistent_table(lines, "eval")
    assert t.count() == 32 and {"score", "level", "tools"} <= set(t.columns) and ("prompt" in t.columns) != ("task" in t.columns)
    assert t.filter(F.col("score").isNull()).count() == 0


def test_no_value_becomes_null(spark):
    odd = {"at": "2025-01-28T03:49:57", "passed": 7, "number": 2**63 + 1, "done": "yes"}
    records = [{"at": 1737009908000 + i, "passed": i % 2 == 0, "number": i, "done": True} for i in range(4)] + [odd]
    lines = exported(spark, [("eval/a", records), ("eval/a", [{"at": "2025-03-01T10:00:00", "number": 9.5}])])
    t = schema_drift.consistent_table(lines, "eval")
    assert dict(t.dtypes) == {"file_name": "string", "line_no": "int", "at": "string", "passed": "string", "number": "string", "done": "boolean"}
    got = {(r.file_name, r.line_no): r for r in t.collect()}
    assert len(got) == 6 and got["eval/a/0", 0].at == "1737009908000" and got["eval/a/0", 4].at == odd["at"] and got["eval/a/1", 0].at == "2025-03-01T10:00:00"
    assert [got["eval/a/0", i].passed for i in (0, 1, 4)] == ["true", "false", "7"] and got["eval/a/0", 4].number == str(odd["number"]) and got["eval/a/0", 4].done is True


def test_fields_of_one_file_are_two_columns(spark):
    lines = exported(spark, [("eval/a", [{"note": f"open card {i}"} for i in range(4)]), ("eval/a", [{"notes": f"open card {i}"} for i in range(4)]), ("eval/a", [{"note": f"open card {i}", "notes": f"close gate {i}", "a.b": 1, "a_b": 2, "A_B": 3, "line_no": 9, "x": {"y": float("nan")}} for i in range(4)])])
    assert ("eval/a/1", "renamed", "note", "notes") in {tuple(r) for r in schema_drift.schema_changes(lines).collect()}
    t = schema_drift.consistent_table(lines, "eval")
    assert len({c.lower() for c in t.columns}) == len(t.columns)
    assert {(r.note, r.notes) for r in t.filter(F.col("file_name") == "eval/a/2").collect()} == {(f"open card {i}", f"close gate {i}") for i in range(4)}
    assert {r.file_name: (r.records, r.n_values) for r in schema_drift.kept_values(lines, ("eval",)).collect()} == {"eval/a/0": (4, 4), "eval/a/1": (4, 4), "eval/a/2": (4, 28)}


def test_moves(spark):
    before = [{"meta": {"why": f"picked by hand {i}"}, "n": i} for i in range(5)]
    lines = exported(spark, [("eval/a", before), ("eval/a", [{"why": r["meta"]["why"], "n": r["n"]} for r in before])])
    assert [tuple(r)[1:] for r in schema_drift.schema_changes(lines, moves=True).collect()] == [("moved", "meta.why", "why")]


def test_a_field_met_in_very_many_batches_adds_up(spark):
    lines = exported(spark, [("eval/a", [{"x": i, "y": "a"} for i in range(300)])]).repartition(7)
    got = {r.path: r.sums for r in schema_drift.field_profiles(lines).collect()}
    assert got["x"][1] == 301 and got["y"][0] == 301 and set(got) == {"x", "y"}


def test_no_files(spark):
    lines = exported(spark, [("eval/a", [{"x": 1}])]).limit(0)
    assert schema_drift.schema_changes(lines).count() == 0
    assert schema_drift.consistent_table(lines, "eval").columns == ["file_name", "line_no"]


def test_assignment_is_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 5):
        cost = rng.random((n, n))
        got = schema_drift.cheapest_assignment(cost)
        assert abs(sum(cost[i, j] for i, j in enumerate(got)) - min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))) < 1e-9


def test_stream_windows_and_duplicates(spark, tmp_path):
    rows = [(i, datetime(2025, 1, 1, i % 3, 5), "a", 1.0) for i in range(9)]
    spark.createDataFrame(rows + rows[:2], "event_id bigint, ts timestamp, kind string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp, kind string, value double").parquet(str(tmp_path / "in"))
    once = windows.run_to_table(windows.once(stream, ["event_id"], "ts", "1 day"), "append")
    assert once.count() == 9
    counted = windows.run_to_table(windows.windowed(stream, "ts", "1 hour", "1 hour", ["kind"], {"n": F.count(F.lit(1))}))
    assert sorted(r.n for r in counted.collect()) == [3, 4, 4]
