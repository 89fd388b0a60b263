"""Core operators on small fixtures: boundaries, ties, nulls, default word lists."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelode.functions import parsing, text
from tracelode.operators import datasets, external, gates, runs, scorelog, similarity, traces

LOG = "id bigint, timestamp timestamp, generation int, skill_name string, model_used string, task_id string, actual_behavior string, raw_score double, latency_ms int, token_cost_estimate double, error_flag string"
T0 = datetime(2025, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=i), g, "s", "m", f"t{i}", "x", x, 1, 0.01, e) for i, (g, x, e) in enumerate(rows)], LOG)


def codes(spark, rows):
    return {r.code for r in scorelog.health_alerts(log(spark, rows)).collect()}


def test_alerts(spark):
    flat = [(g, 0.5 + k / 100, None) for g in (1, 2, 3) for k in range(5)]
    assert codes(spark, flat) == {"STD_DEV_FLAT"}
    assert codes(spark, [(g if g < 3 else 4, x, e) for g, x, e in flat]) == set()
    spread = [0.2, 0.5, 0.8]
    assert codes(spark, [(g, x, None) for g in (1, 2, 3) for x in (0.94, 0.93, 0.92)]) == {"STD_DEV_FLAT", "RUBBER_STAMP"}
    assert codes(spark, [(g, x, None) for g in (1, 2, 3) for x in (0.0, 0.3, 0.05)]) >= {"OVERLY_HARSH"}
    assert codes(spark, [(1, x, None) for x in spread] + [(1, 0.0, "timeout")]) == {"JUDGE_ERRORS"}
    assert codes(spark, [(1, x, None) for x in (0.05, 0.95, 0.0, 1.0, 0.5)]) == set()
    assert codes(spark, [(1, x, None) for x in (0.05, 0.95, 0.0, 1.0, 1.0, 0.5)]) == {"DEAD_ZONE"}
    assert codes(spark, []) == set()


def test_suffix_is_not_per_generation(spark):
    got = {r.generation: r for r in scorelog.since_generation(log(spark, [(1, 0.1, None), (1, 0.9, None), (3, 0.5, None)])).collect()}
    assert got[1].n == 3 and got[1].mean_score == 0.5 and got[3].std_score is None and got[3].mean_score == 0.5


def test_summary_of_nothing(spark):
    r = scorelog.summary(log(spark, [])).first()
    assert r.n == 0 and r.error_rate == 0 and r.mean_score is None and r.total_cost == 0


@pytest.mark.parametrize("pairs,kappa", [([(0.1, 0.2), (0.5, 0.4), (0.9, 0.8)], 1.0), ([(0.1, 0.9), (0.9, 0.1)], -1.0), ([(0.1, 0.1), (0.2, 0.3)], 1.0), ([(0.35, 0.5), (0.7, 0.71), (0.34, 0.35)], 0.5)])
def test_kappa(spark, pairs, kappa):
    assert scorelog.kappa(spark.createDataFrame(pairs, "tier1 double, tier2 double")).first().kappa == pytest.approx(kappa, abs=1e-6)


RUNS = "run_id string, skill string, ts timestamp, baseline_score double, evolved_score double, improvement double, elapsed_seconds double, constraints_passed boolean"


def run_rows(spark, scores, improvement=None, skill="s"):
    rows = [(f"v2_2025010{1 + i // 24}_{i % 24:02d}0000", skill, T0 + timedelta(hours=i), 0.5, s, (improvement or [0.0] * len(scores))[i], 100.0, True) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, RUNS)


def test_plateau_and_backtrack(spark):
    r = run_rows(spark, [0.5, 0.6, 0.604, 0.608])
    assert [x.plateau for x in runs.plateaus(r).orderBy("run_id").collect()] == [False, False, False, True]
    assert runs.backtrack_targets(r).first().target == "v2_20250101_000000"
    assert runs.backtrack_targets(run_rows(spark, [0.5, 0.5, 0.5, 0.5])).first().target == "v2_20250101_010000"
    assert runs.backtrack_targets(run_rows(spark, [0.5])).first().target == "v2_20250101_000000"
    actions = [x.action for x in runs.backtrack_actions(run_rows(spark, [0.5] * 7)).orderBy("run_id").collect()]
    assert actions == ["continue", "continue", "backtrack", "backtrack", "backtrack", "force_archive", "force_archive"]


def test_breaker(spark):
    is_open = lambda imp, cost: runs.cost_breaker(run_rows(spark, [0.5] * len(imp), imp), F.lit(cost)).first()
    assert is_open([0.0, 0.0, 0.0], 0.02).open and not is_open([0.0, 0.0], 0.02).open and not is_open([0.0, 0.0, 0.0], 0.001).open
    assert not is_open([0.0, 0.1, 0.0], 0.02).open and not is_open([0.0, 999.0, 0.0], 0.02).open and is_open([0.1, 0.0, 0.0, 0.0], 0.02).open


def test_power_law_finds_a_known_exponent(spark):
    r = runs.power_law(run_rows(spark, [0.3] + [0.3 + 0.1 * i**0.5 for i in range(2, 30)])).first()
    assert r.n == 29 and r.exponent > 0.3
    assert runs.power_law(run_rows(spark, [0.1, 0.2, 0.3])).count() == 0


def test_skyline_is_strict(spark):
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 1.0), ("d", 0.5, 2.0), ("e", 2.0, 1.0), ("f", None, 9.0)], "k string, x double, y double")
    assert {r.k for r in runs.skyline(points, "x", "y").collect()} == {"b", "c", "e"}


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, s string"), spark.createDataFrame([("b", None, "y"), ("c", 3, "z"), ("a", 5, "q")], "k string, v int, s string")
    got = {r.k: (r.v, r.s, r.change) for r in runs.upsert(old, new, "k", keep=("s",)).collect()}
    assert got == {"a": (5, "x", "update"), "b": (2, "y", "update"), "c": (3, "z", "insert")}


MSG = "message_id bigint, session_id string, ordinal int, role string, content string, tool_calls array<string>, source string, project string"


def msgs(spark, rows):
    return spark.createDataFrame([(i, s, o, r, c, t, None, None) for i, (s, o, r, c, t) in enumerate(rows)], MSG)


def test_turns(spark):
    m = msgs(spark, [("s", 0, "user", "first", None), ("s", 1, "assistant", None, ["run"]), ("s", 2, "tool", "ok", None), ("s", 3, "ai", "answer", []), ("s", 4, "user", "second", None), ("s", 5, "user", "third", None), ("s", 6, "assistant", "a", None), ("s", 7, "assistant", "b", ["x", "run"])])
    pairs = [(r.task_input, r.response) for r in traces.turn_pairs(m).orderBy("turn").collect()]
    assert pairs == [("first", "answer"), ("second", ""), ("third", "a")]
    assert [(r.task_input, r.response) for r in traces.joined_pairs(m, least=1).orderBy("turn").collect()] == [("first", "answer"), ("third", "a\nb")]
    assert [(r.tool_name, r.task) for r in traces.tool_requests(m).orderBy("message_id", "call_no").collect()] == [("run", "first"), ("x", "third"), ("run", "third")]
    r = traces.tool_sequences(m).first()
    assert (r.tools, r.calls, r.capturable) == ("run,x", 3, True)


def test_default_failure_words(spark):
    long = "We could take option one, or option two. " + "x" * 500
    m = msgs(spark, [("a", 0, "user", "q", None), ("a", 1, "assistant", long, ["t"]), ("b", 0, "user", "q", None), ("b", 1, "assistant", "difficulty: hard. Let me check. " + "y" * 200, None), ("c", 0, "assistant", "This skill is deprecated. " + "z" * 100, ["t"])])
    got = {(r.session_id, r.failure_class) for r in traces.failures(m).collect()}
    assert got == {("a", "long_briefing"), ("a", "raw_dump"), ("b", "tool_underuse"), ("c", "skill_drift")}


def test_default_outcome_words(spark):
    m = msgs(spark, [("a", 0, "user", "please", None), ("a", 1, "assistant", "All done and saved.", None), ("b", 0, "user", "that's wrong, try again", None), ("b", 1, "user", "not correct", None), ("c", 0, "user", "try again", None), ("c", 1, "assistant", "done, saved, fixed", None), ("d", 0, "user", "hm", None)])
    assert {r.session_id: r.outcome for r in traces.outcomes(m).collect()} == {"a": "succeeded", "b": "failed", "c": "partial", "d": "unknown"}


@pytest.mark.parametrize("value,secret", [("my sk-" + "a" * 20, True), ("ask-me sk-short", False), ("Authorization: BEARER " + "x" * 20, True), ("the bearer of news", False), ("token = 0123456789", True), ("token=short", False), ("password: x", True), ("the password is lost", False), ("ſecret = x", True), ("password = x", True), ("AKIA" + "A" * 16, True), (None, False)])
def test_secrets(spark, value, secret):
    assert spark.createDataFrame([(value,)], "t string").select(datasets.contains_secret(F.col("t"))).first()[0] is secret


EX = "example_id bigint, task_input string, expected_behavior string, difficulty string, category string, split string"


def test_validation_and_splits(spark):
    d = spark.createDataFrame([(1, "x" * 3000, " y ", "HARD ", None, "train"), (2, "", "y", None, "c", "val"), (3, "t", None, None, "c", "val"), (4, "t", "y", "unknown", " ", None)], EX)
    got = {r.example_id: r for r in datasets.validated(d).collect()}
    assert set(got) == {1, 4} and len(got[1].task_input) == 2000 and got[1].difficulty == "hard" and got[4].difficulty == "medium" and got[4].category == "general"
    for n, want in ((1, [1, 0, 0]), (2, [1, 1, 0]), (3, [1, 1, 1]), (20, [10, 5, 5])):
        e = spark.createDataFrame([(i, f"task {i}", "", None, None, None) for i in range(n)], EX)
        count = {r.split: r["count"] for r in datasets.ratio_split(e, F.col("task_input")).groupBy("split").count().collect()}
        assert [count.get(s, 0) for s in ("train", "val", "holdout")] == want


def test_merge_prefers_earlier_splits(spark):
    old = spark.createDataFrame([(1, "a", "", None, None, "train")], EX)
    new = spark.createDataFrame([(2, "a", "", None, None, "val"), (3, "b", "", None, None, "holdout"), (4, "b", "", None, None, "Train "), (5, "c", "", None, None, "val"), (6, "c", "", None, None, "val"), (7, None, "", None, None, "val")], EX)
    assert {r.split: r.added for r in datasets.merged(old, new).collect()} == {"train": 1, "val": 1}


def test_text_functions(spark):
    doc = "---\nname: 'x'\nname: y\ndescription: d\n---\n# A b\ntext\n## Steps\n1. go\n- item\n"
    r = spark.createDataFrame([(doc, "0.7", " 2w ", "  ")], "t string, s string, a string, e string").select(
        text.front_matter_field(F.col("t"), "name"), text.headings(F.col("t")), datasets.slug(text.body(F.col("t"))), text.age_hours(F.col("a")), text.age_hours(F.col("s")), text.parse_score("s"), text.parse_score("a"), text.cut_short(F.lit("x" * 381)), text.token_estimate(F.lit("a b c d")), F.size(text.word_set(F.col("e")))
    ).first()
    assert list(r)[:5] == ["y", ["A b", "Steps"], "a-b", 336, None] and r[5] == 0.7 and r[6] == 0.5 and len(r[7]) == 380 and r[8] == 4 and r[9] == 0


def test_gates(spark):
    pairs = spark.createDataFrame([(1, "n", "## Steps\nrun the tool", "## Role\nrun the tool " + "novel term " * 3), (2, "n", "", ""), (3, "n", "same text here", "same text here")], "doc_id bigint, name string, baseline string, evolved string")
    assert {(r.doc_id, r.section, r.change) for r in gates.section_changes(pairs).collect()} == {(1, "Steps", "removed"), (1, "Role", "added")}
    assert {r.doc_id: r.status for r in gates.scope_creep(pairs).collect()}[3] == "match"
    size = {r.doc_id: r for r in gates.size_checks(pairs).collect()}
    assert not size[2].non_empty and size[3].growth == 0.0 and size[3].growth_ok
    choice = {r.id: r.choice for r in gates.pareto_choice(spark.createDataFrame([(1, 0.5, 0.52, 0.0), (2, 0.5, 0.6, 0.1), (3, 0.5, 0.6, 2.0)], "id int, baseline_score double, evolved_score double, growth double")).collect()}
    assert choice == {1: "baseline", 2: "evolved", 3: "baseline"}


def test_diversity_equals_the_pair_mean(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, "omega sigma")], "id bigint, t string")
    counts = similarity.term_counts(d, "id", F.col("t"))
    w = similarity.weights(counts, similarity.vocabulary(counts, d))
    v = {}
    for r in w.collect():
        v.setdefault(r.id, {})[r.term] = r.w
    cos = [sum(v[a].get(t, 0) * x for t, x in v[b].items()) for a in v for b in v if a != b]
    assert similarity.diversity(w).first().diversity == pytest.approx(1 - sum(cos) / len(cos), abs=1e-5)


def test_parsing(spark):
    d = spark.createDataFrame([("```json\n{'a': 1,}\n```",), ('noise {"a": {"b": "}"}} tail',), ("nothing",), (None,)], "t string")
    got = d.select(parsing.repair_json("t").alias("r"), parsing.scoring_json("t").alias("s")).collect()
    assert [x.r for x in got] == ['{"a": 1}', '{"a": {"b": "}"}}', None, None] and got[1].s == '{"a": {"b": "}"}}' and got[2].s is None
    e = spark.createDataFrame([("a\nb", "a\nc\nd", "<payload_json>```json\n{}\n```</payload_json>", "- run: does it\n- run: later\n* see: x")], "a string, b string, p string, m string").select(parsing.text_diff("a", "b").alias("d"), parsing.tagged_payload(F.col("p")).alias("p"), parsing.described(F.col("m")).alias("m")).first()
    assert (e.d.added, e.d.removed) == (2, 1) and e.p == "{}" and e.m == {"run": "later", "see": "x"}


def test_injected_calls_report_errors(spark):
    def judge(frame):
        if (frame["x"] > 2).any():
            raise ValueError("too large")
        return frame[["x"]].rename(columns={"x": "y"})

    got = {r.x: (r.y, r.error) for r in external.filtered_call(spark.range(6).select(F.col("id").alias("x")), F.col("x") > 0, ["x"], 3, judge, ["x"], "y bigint", 2).collect()}
    assert got[1] == (1, None) and got[2] == (2, None) and got[3] == (None, "ValueError: too large") and len(got) == 3


def test_running_sums_cross_chunks(spark):
    from tracelode.operators.ordering import running_sums

    rows = [(g, i, i % 3) for g in ("a", "b") for i in range(17)] + [("c", None, 5)]
    d = spark.createDataFrame(rows, "g string, i bigint, x bigint")
    got = running_sums(d, ["g"], F.floor(F.col("i") / 4), [F.col("i")], {"s": F.col("x"), "n": F.lit(1)}).collect()
    assert len(got) == 35 and all(r.s == sum(k % 3 for k in range(r.i + 1)) and r.n == r.i + 1 for r in got if r.i is not None)


def test_similar_sets_equal_brute_force(spark):
    import random

    random.seed(7)
    texts = {i: " ".join(random.choice("a b c d e f g h the the of".split()) for _ in range(random.randint(0, 8))) for i in range(60)}
    d = spark.createDataFrame(list(texts.items()), "id bigint, t string")
    got = {(r.query_id, r.id) for r in similarity.similar_sets(d.filter("id % 10 = 0"), d, "id", "t", 0.5, 1000).collect()}
    sets = {i: set(t.split()) for i, t in texts.items()}
    assert got == {(q, i) for q in range(0, 60, 10) for i in range(60) if q != i and sets[q] | sets[i] and len(sets[q] & sets[i]) > 0.5 * len(sets[q] | sets[i])}


def test_release_keeps_what_is_not_this_applications(spark):
    import os

    from tracelode import session

    table = session.materialise(spark.range(3), "kept")
    root = session.shared_dir(spark).removeprefix("file:")
    root = "/" + root.lstrip("/")
    other = os.path.join(root, "tracelode", "another-application", "tables")
    os.makedirs(other, exist_ok=True)
    file = session.write_shared(spark, "lexicon-1.bin", b"x")
    assert table.count() == 3
    session.release(spark)
    assert os.path.exists(other) and os.path.exists("/" + file.removeprefix("file:").lstrip("/"))
    assert not os.path.exists(os.path.join(root, "tracelode", spark.sparkContext.applicationId, "tables"))
    os.removedirs(other)


def test_a_machine_local_folder_is_refused_on_a_cluster():
    import pytest

    from tracelode import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_lags_cross_chunks(spark):
    from tracelode.operators.ordering import running_sums

    d = spark.createDataFrame([("a", i, None if i % 5 == 0 else i) for i in range(30)] + [("b", 3, 1), ("a", None, 7)], "g string, i int, x int").repartition(5)
    got = {(r.g, r.i): r.p for r in running_sums(d, ["g"], F.floor(F.col("i") / 4), ["i"], lags={"p": F.col("x")}).collect()}
    assert got["a", None] is None and got["a", 0] == 7 and got["b", 3] is None
    assert all(got["a", i] == (None if (i - 1) % 5 == 0 else i - 1) for i in range(1, 30))


def test_one_name_of_half_the_versions_is_cut_by_the_hour(spark):
    from datetime import datetime, timedelta

    from tracelode.operators import gates

    rows = [(i, "hot" if i % 2 else f"n{i % 7}", f"text {i}", datetime(2025, 1, 1) + timedelta(minutes=10 * i)) for i in range(200)]
    got = {r.doc_id: r.baseline for r in gates.version_pairs(spark.createDataFrame(rows, "doc_id bigint, skill_name string, text string, written_at timestamp")).collect()}
    assert all(got[i] == f"text {i - 2}" for i in range(3, 200, 2)) and 1 not in got


def test_skyline_equals_brute_force_over_ranges(spark, monkeypatch):
    import random

    from tracelode.operators import runs

    monkeypatch.setattr(runs, "RANGES", 7)
    random.seed(2)
    points = [(i, random.randint(0, 40) / 3, random.randint(0, 40)) for i in range(300)] + [(900, None, 5), (901, 3.0, None)]
    d = spark.createDataFrame(points, "id int, x double, y int")
    whole = [p for p in points if p[1] is not None and p[2] is not None]
    want = {p[0] for p in whole if not any(q[1] >= p[1] and q[2] >= p[2] and (q[1] > p[1] or q[2] > p[2]) for q in whole)}
    assert {r.id for r in runs.skyline(d, "x", "y").collect()} == want
    assert runs.skyline(d.filter("id < 0"), "x", "y").count() == 0
