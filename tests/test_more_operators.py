"""Operators that no query over the test tables uses: checks, drift of front matter, writers, further readers."""

import json

import pytest
from pyspark.sql import functions as F

from tracelode.operators import checks, external, gates, traces
from tracelode.sources import readers, sinks


def test_missing_paths(spark):
    d = spark.createDataFrame([(1, ("x", None)), (2, None)], "id int, a struct<b: string, c: string>")
    got = {r.id: r.missing for r in checks.missing_paths(d, ["a.b", "a.c", "a.d", "id"]).collect()}
    assert got == {1: ["a.c", "a.d"], 2: ["a.b", "a.c", "a.d"]}


def test_config_drift(spark):
    head = "---\nname: {}\ndescription: d\n---\nbody"
    d = spark.createDataFrame([(1, "n", head.format("a"), head.format("'a'")), (2, "n", head.format("a"), head.format("b"))], "doc_id bigint, name string, baseline string, evolved string")
    assert {(r.doc_id, r.same_name, r.same_description) for r in gates.config_drift(d).collect()} == {(1, True, True), (2, False, True)}


def test_sections_and_rubric(spark):
    d = spark.createDataFrame([(1, "---\nname: x\n---\nintro\n## A\none\n\n## B\ntwo")], "doc_id bigint, text string")
    assert [r.section for r in checks.sections(d, "doc_id", "text").orderBy("section_no").collect()] == ["---\nname: x\n---\nintro", "## A\none", "## B\ntwo"]
    assert d.select(checks.rubric(F.col("text"))).first()[0] == "one"


def test_section_similarity(spark):
    a, b = "## A\nalpha beta gamma\n## B\ndelta epsilon zeta", "## X\nomega sigma kappa"
    d = spark.createDataFrame([(1, "n", a, a), (2, "n", a, b)], "doc_id bigint, name string, baseline string, evolved string")
    got = {r.doc_id: r.similarity for r in checks.section_similarity(d).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0


def test_audit_with_runs(spark):
    audit, best = spark.createDataFrame([("a", 3), ("b", 4)], "group string, n int"), spark.createDataFrame([("a", "r", 0.1)], "skill string, run_id string, improvement double")
    assert {(r.group, r.improvement) for r in checks.audit_with_runs(audit, best).collect()} == {("a", 0.1), ("b", None)}


def test_fitness(spark):
    f = lambda size: spark.range(1).select(external.fitness(F.lit(1.0), F.lit(0.5), F.lit(0.5), F.lit(size), 100)).first()[0]
    assert f(90) == pytest.approx(0.75) and f(95) == pytest.approx(0.6) and f(200) == pytest.approx(0.45)


def test_carried_forward(spark):
    d = spark.createDataFrame([("f", 0, "x"), ("f", 1, "# A"), ("f", 2, "y"), ("f", 3, "# B"), ("f", 4, "z")], "f string, n int, line string")
    head = traces.carried_forward(d, F.col("line").startswith("#"), F.col("line"), "f", ["n"])
    assert [r.h for r in d.withColumn("h", head).orderBy("n").collect()] == [None, "# A", "# A", "# B", "# B"]


def test_logs_grow(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", 0.5, "text", None)], "id int, skill_name string, raw_score double, actual_behavior string, error_flag string")
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(sinks.error_row(rows, "timeout"), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log")).orderBy(F.desc("raw_score")).collect()
    assert [(r.raw_score, r.actual_behavior, r.error_flag) for r in got] == [(0.5, "text", None), (0.0, "[ERROR]", "timeout")]
    for _ in range(2):
        sinks.append_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2


def test_candidates_cards_and_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for i, status in enumerate(("new", "done")):
        (tmp_path / "c" / f"{i}.json").write_text(json.dumps({"session_id": str(i), "task": "t", "skill_body": "xyz", "status": status, "domain_tags": ["a", "b"]}))
    assert [tuple(r) for r in readers.read_candidates(spark, str(tmp_path / "c"), "new").collect()] == [("0", "t", "new", 3, 2, 0)]
    (tmp_path / "cards.json").write_text(json.dumps([{"title": "a", "age_hours": 200}, {"title": "b"}]))
    assert {r.title: r.is_stale for r in readers.read_cards(spark, str(tmp_path / "cards.json")).collect()} == {"a": True, "b": False}
    assert {(r.source, r.n) for r in readers.source_counts(spark.createDataFrame([("x",), ("x",)], "source string"), ["x", "y"]).collect()} == {("x", 2), ("y", 0)}
