"""Scenarios of the state machine, polls, reviews and lookups, and properties of the expressions."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from runlens.functions import jsontext as J
from runlens.functions import scalars as S
from runlens.operators import episodes, runs, texts, tools
from runlens.sources import records
from runlens.streaming import controller


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def attempts(spark, oks, run=1):
    return spark.createDataFrame([(run, i, f"branch-{i}", ok) for i, ok in enumerate(oks, 1)], "run long, ord long, branch string, ok boolean")


def test_promotes_last_success(spark):
    a = attempts(spark, [True, True])
    assert runs.last_anchor(a, "run", "branch", F.col("ok"), F.col("ord")).first().anchor == "branch-2"


def test_three_failures_halt_and_keep_the_anchor(spark):
    a = runs.until_halt(attempts(spark, [False, False, False, True]), "run", ~F.col("ok"), ["ord"])
    got = a.orderBy("ord").collect()
    assert [r.sleep_s for r in got] == [1200, 1200, 1200]
    anchored = runs.with_anchor(attempts(spark, [False, False, False]), "run", "branch", F.col("ok"), ["ord"], F.lit("parent-0"))
    assert {r.anchor for r in anchored.collect()} == {"parent-0"}


def test_anchor_is_seen_by_the_next_attempt_only(spark):
    got = runs.with_anchor(attempts(spark, [True, False, True, True]), "run", "branch", F.col("ok"), ["ord"], F.lit("p")).orderBy("ord").collect()
    assert [r.anchor for r in got] == ["p", "branch-1", "branch-1", "branch-3"]


def test_bootstrap_does_not_count_as_episode(spark):
    a = attempts(spark, [True, True, True])
    got = runs.up_to_episode(a, "run", F.col("ok"), ["ord"], 1, bootstrap=F.col("ord") == 1).collect()
    assert [(r.branch, r.episode_no) for r in got] == [("branch-2", 1)]
    assert runs.up_to_episode(a, "run", F.col("ok"), ["ord"], 0).count() == 3


def test_tracker_seed(spark):
    got = runs.tracker_range(attempts(spark, [False, True, True]), "run", "branch", F.col("ok"), F.col("ord"), F.lit("seed")).first()
    assert (got.start, got.latest) == ("seed", "branch-3")


@pytest.mark.parametrize(
    ("mode", "snap", "parents", "fresh"),
    [
        ("poll", "s1", [], True),
        ("poll", "s1", [("p", "s1", False, False)], False),
        ("poll", "S1 ", [("p", "s1", False, False)], False),
        ("poll", "s2", [("p", "s1", False, False)], True),
        ("poll", "s1", [("p", "", False, False)], True),
        ("poll", "s1", [("p", None, True, False)], False),
        ("poll", "s1", [("p", None, False, True)], True),
        ("rebootstrap", "s1", [("p", None, False, True)], False),
    ],
)
def test_freshness(spark, mode, snap, parents, fresh):
    child = spark.createDataFrame([("c", " P", snap)], "id string, parent_id string, snap string")
    p = spark.createDataFrame(parents, "id string, snap string, error boolean, payload_error boolean")
    assert runs.freshness(child, p, "parent_id", "id", "snap", mode).first().fresh is fresh


def test_lineage_deeper_than_the_default_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(150)], "id string, parent string")
    got = {r.node: (r.root, r.depth) for r in runs.lineage(spark, edges, "id", "parent").collect()}
    assert got["n149"] == ("n0", 149) and len(got) == 150


def test_lineage_of_forests_and_cycles(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "a"), ("self", "self"), ("r", None), ("x", "gone"), ("y", "x"), (None, "r"), *((f"k{i}", "r") for i in range(30))]
    got = {r.node: (r.root, r.depth) for r in runs.lineage(spark, spark.createDataFrame(edges, "id string, parent string"), "id", "parent").collect()}
    assert got == {"a": (None, None), "b": (None, None), "c": (None, None), "self": (None, None), "r": ("r", 0), "x": ("x", 0), "y": ("x", 1)} | {f"k{i}": ("r", 1) for i in range(30)}
    assert runs.lineage(spark, spark.createDataFrame([], "id string, parent string"), "id", "parent").count() == 0


@pytest.mark.parametrize(
    ("first", "longest", "waits"),
    [(60, 300, [60, 90, 135, 202, 300, 300]), (3, 30, [3, 4, 6, 9, 13, 19, 28, 30, 30]), (1, 30, [1, 1, 1]), (0.5, 30, [0.5, 0, 0])],
)
def test_backoff(spark, first, longest, waits):
    assert one(spark, S.backoff_waits(F.lit(first), F.lit(longest), len(waits))) == waits


def test_poll_outcomes_in_order(spark):
    rows = [("a", 1, None, False, "a", "running", True, 0.0), ("a", 2, None, True, "", "failed", True, 9.0), ("b", 1, "boom", True, "b", "failed", True, 0.0), ("c", 1, None, False, "c", "failed", False, 0.0), ("c", 2, None, False, "c", "running", True, 30000.0), ("d", 1, None, False, "d", " FINISHED", True, 30000.0)]
    p = spark.createDataFrame(rows, "branch_id string, poll_no int, get_error string, has_error boolean, id string, status string, fresh boolean, elapsed double")
    got = {r.branch_id: r.outcome for r in runs.poll_outcome(p).collect()}
    assert got == {"a": "error_payload", "b": "get_error", "c": "timeout", "d": "success"}


def test_review_retries_only_missing_artifacts(spark):
    rows = [(1, 1, "404: x", None), (1, 2, "MCP HTTP 404 y", None), (1, 3, None, "ok"), (2, 1, "404", None), (2, 2, "404", None), (2, 3, "404", None), (3, 1, "reset", None), (4, 1, None, "  ")]
    a = spark.createDataFrame(rows, "review int, attempt int, error string, content string")
    got = {r.review: (r.result, r.attempts, r.review_report) for r in runs.review_result(a).collect()}
    assert got == {1: ("done", 3, "ok"), 2: ("exhausted", 3, None), 3: ("error", 1, None), 4: ("done", 1, None)}


def test_unicode_trim_and_overlay(spark):
    assert one(spark, S.trim_all(F.lit(" \t x　\n"))) == "x"
    assert one(spark, S.overlay(F.lit("x"), F.lit("  "))) == "x"
    assert one(spark, S.overlay(F.lit("x"), F.lit(" p "))) == "p"
    assert one(spark, S.overlay(F.lit("x"), F.lit(" t "), trimmed=False)) == " t "
    assert one(spark, S.endpoint(F.lit(""), F.lit("u"))) == "u" and one(spark, S.legacy_endpoint(F.lit(""), F.lit("u"))) == ""
    assert one(spark, S.legacy_endpoint(F.lit("a"), F.lit("u"))) == "u"
    assert one(spark, S.endpoint(F.lit(None).cast("string"), F.lit(" "))) == S.DEFAULT_URL


def test_terminal_failure(spark):
    assert one(spark, S.is_terminal_failure(F.lit("FINISHED_WITH_ERROR"), F.lit("Failed "))) is True
    assert one(spark, S.is_terminal_failure(F.lit("FINISHED_WITH_ERROR"), F.lit(None).cast("string"))) is False


def test_excerpt_cuts_bytes(spark):
    assert bytes(one(spark, S.byte_excerpt(F.lit("é" * 300)))) == ("é" * 300).encode()[:400] + b"..."
    assert bytes(one(spark, S.byte_excerpt(F.lit("abc")))) == b"abc"


def test_call_attempts(spark):
    rows = [(1, 0, False, False), (1, 1, False, True), (1, 2, True, False), (2, 0, False, False), (2, 1, False, False), (2, 2, False, False)]
    a = spark.createDataFrame(rows, "call int, attempt int, ok boolean, body_error boolean")
    got = {r.call: (r.attempts, r.succeeded_at, r.waited_s) for r in tools.call_attempts(a).collect()}
    assert got == {1: (3, 2, 1), 2: (3, None, 3)}


BEGIN = ("start", "", True, False, None, 0, 0, 0, 0, None, False)


def taken(oks, most=0):
    state = BEGIN
    for i, ok in enumerate(oks, 1):
        state = episodes.transition(state, {"branch": f"b{i}", "poll": "success" if ok else "failed", "output": "x"}, most)
    return state


@given(st.lists(st.booleans(), max_size=30))
@settings(max_examples=200, deadline=None)
def test_state_machine_properties(oks):
    anchor, active, initialized, _, _, n, launches, streak, slept, error, ended = taken(oks)
    assert n == sum(oks[:launches]) and streak <= 3 and ended == (streak == 3) == (error == "failed")
    assert anchor == max((f"b{i}" for i in range(1, launches + 1) if oks[i - 1]), default="start", key=lambda b: int(b[1:]) if b[1:].isdigit() else 0)
    assert slept == 1200 * (launches - n) and active == "" and initialized


def recorded(spark, runs_):
    rows = [(run, seq, *(step.get(c.split()[0]) for c in episodes.STEP.split(", ")[2:])) for run, steps in runs_.items() for seq, step in enumerate(steps, 1)]
    return spark.createDataFrame(rows, episodes.STEP)


def begun(spark, rows):
    return episodes.start(spark.createDataFrame(rows, episodes.RUN))


def win(branch=None, **more):
    return {"branch": branch, "poll": "success", "output": "ok", **more}


def test_batch_equals_the_machine(spark):
    rng = random.Random(3)
    kinds = [{}, {}, {}, {"poll": "failed"}, {"poll": "failed"}, {"poll": "timeout"}, {"poll": None}, {"output": " \n"}, {"output": None}, {"output_error": "x"}, {"launch_error": "x"}, {"is_error": True}, {"branch": " "}, {"branch": None}, {"stop": True}, {"poll": "failed", "stop_after": True}]
    weights = [12, 8, 8, 9, 9, *[1] * 11]
    steps, rows, want = {}, [], {}
    for i in range(400):
        run = f"r{i}"
        steps[run] = [win(f" b{j}") | k for j, k in enumerate(rng.choices(kinds, weights, k=rng.randrange(9)))]
        active, initialized, again, most = rng.choice(["", "", "kept "]), rng.random() < 0.7, rng.random() < 0.2, rng.choice([0, 0, 1, 2, 3])
        rows.append((run, rng.choice(["a0", " ", None]), "p0", active, initialized, again, "proj", most))
        boot = again or not initialized
        state = (((rows[-1][1] or "").strip() or "p0"), "" if again else active.strip(), initialized, boot, None, 0, 0, 0, 0, None, False)
        for step in steps[run]:
            state = episodes.transition(state, step, most)
        want[run] = (*state[:3], *state[4:10])
    started = begun(spark, rows)
    got = episodes.final_states(episodes.steps(recorded(spark, steps), started), started).collect()
    assert {r.run: tuple(r)[1:] for r in got} == want
    assert {w[-1] for w in want.values()} == {None, "failed", "poll_error", "output_error", "blank_output", "launch_error", "launch_rejected", "missing_branch"}


def state_after(spark, steps, anchor="", active="", initialized=False, parent="", rebootstrap=False, most=0, lookups=None):
    run = spark.createDataFrame([("r", anchor, parent, active, initialized, rebootstrap, "p", most)], episodes.RUN)
    found = None if lookups is None else episodes.still_running(spark.createDataFrame(lookups, "run string, branch string, error string, payload_error string, status string, latest_snap_id string, parent_id string"), spark.createDataFrame([], "id string, error boolean, payload_error boolean, latest_snap_id string"))
    started = episodes.start(run, found)
    done = episodes.steps(recorded(spark, {"r": steps}), started)
    return done.orderBy("seq").collect(), episodes.final_states(done, started).first()


def test_scenario_promote(spark):
    done, end = state_after(spark, [win("branch-1"), win("branch-2"), win("branch-3")], parent="parent-0", most=1)
    assert (end.anchor, end.active, end.initialized, end.bootstrap_branch, end.launches, end.error) == ("branch-2", "", True, "branch-1", 2, None)
    assert [(r.parent, r.episode_no) for r in done] == [("parent-0", None), ("branch-1", 1)]


def test_scenario_three_failures(spark):
    done, end = state_after(spark, [win(f"branch-{i}", poll="failed") for i in (1, 2, 3, 4)], parent="parent-0")
    assert [r.sleep_s for r in done] == [1200] * 3
    assert (end.anchor, end.active, end.initialized, end.bootstrap_branch, end.launches, end.error) == ("parent-0", "", False, None, 3, "failed")


def test_scenario_resume(spark):
    done, end = state_after(spark, [win()], anchor="parent-0", active="branch-77", initialized=True, most=1)
    assert (end.anchor, end.active, end.launches, end.error) == ("branch-77", "", 0, None) and not done[0].launched


def test_scenario_saved_anchor(spark):
    done, _ = state_after(spark, [win("branch-1")], anchor="anchor-from-file", initialized=True, most=1)
    assert [(r.parent, r.launched) for r in done] == [("anchor-from-file", True)]


def test_scenario_rebootstrap(spark):
    _, end = state_after(spark, [win("branch-1"), win("branch-2")], anchor="parent-0", initialized=True, rebootstrap=True, most=1)
    assert (end.anchor, end.bootstrap_branch, end.launches, end.initialized) == ("branch-2", "branch-1", 2, True)


def test_scenario_rebootstrap_while_running(spark):
    done, end = state_after(spark, [win("branch-1")], anchor="parent-0", active="branch-77", initialized=True, rebootstrap=True, lookups=[("r", "branch-77", None, None, "running", None, None)])
    assert not done and end.launches == 0 and end.active == "branch-77" and "branch-77" in end.error and "running" in end.error


@pytest.mark.parametrize("found", [(None, "404: gone", None), (None, None, " Succeed")])
def test_scenario_rebootstrap_after_a_stop(spark, found):
    error, payload, status = found
    _, end = state_after(spark, [win("branch-1"), win("branch-2")], anchor="parent-0", active="branch-77", initialized=True, rebootstrap=True, most=1, lookups=[("r", "branch-77", error, payload, status, None, None)])
    assert (end.anchor, end.bootstrap_branch, end.active, end.launches, end.error) == ("branch-2", "branch-1", "", 2, None)


def test_runs_that_cannot_start(spark):
    rows = [("a", "", "", "", False, False, "p", 0), ("b", "x", "", "", True, False, " ", 0), ("c", "x", "", "k", True, True, "", 0)]
    look = spark.createDataFrame([("c", None, None, "boom")], "run string, running boolean, status string, problem string")
    got = {r.run: r.error for r in episodes.start(spark.createDataFrame(rows, episodes.RUN), look).collect()}
    assert got == {"a": episodes.NO_PARENT, "b": episodes.NO_PROJECT, "c": "check active episode branch k before rebootstrap: boom"}


def test_still_running(spark):
    rows = [("a", "x", None, None, "failed", "s1", "P "), ("b", "x", None, None, "failed", "s2", "p"), ("c", "x", None, None, "failed", "s1", "bad"), ("d", "x", "reset", None, None, None, None), ("e", "x", None, "Not Found", None, None, None), ("f", "x", None, "denied", None, None, None), ("g", "x", None, None, "running", None, None)]
    parents = spark.createDataFrame([("p", False, False, "S1"), ("bad", False, True, None)], "id string, error boolean, payload_error boolean, latest_snap_id string")
    got = {r.run: (r.running, r.status, r.problem) for r in episodes.still_running(spark.createDataFrame(rows, "run string, branch string, error string, payload_error string, status string, latest_snap_id string, parent_id string"), parents).collect()}
    assert got == {"a": (True, "failed", None), "b": (False, "failed", None), "c": (True, "failed", None), "d": (None, None, "reset"), "e": (False, "not_found", None), "f": (None, None, "GetBranch returned error: denied"), "g": (True, "running", None)}


def test_stream_takes_steps_in_turn_and_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    rng = random.Random(9)
    runs_ = {f"r{i}": [win(f"b{j}", poll=rng.choice(["success", "success", "failed"])) for j in range(rng.randrange(1, 12))] for i in range(12)}
    every = recorded(spark, runs_)
    rows = every.collect()
    rng.shuffle(rows)
    stream = lambda: controller.track(spark.readStream.schema(episodes.STEP).parquet(src), "start")
    for part in (rows[:30], rows[20:60], rows[60:]):  # late, early and repeated steps
        spark.createDataFrame(part, episodes.STEP).coalesce(1).write.mode("append").parquet(src)
        controller.run_to_end(stream(), out, check)
    got = {r.run: tuple(r[c] for c in ("anchor", "active", "initialized", "bootstrap_branch", "episodes", "launches", "streak", "slept_s", "error")) for r in texts.latest_by_key(spark.read.parquet(out), "run", "seq").collect()}
    started = begun(spark, [(r, "start", "", "", True, False, "p", 0) for r in runs_])
    want = episodes.final_states(episodes.steps(every, started), started)
    assert got == {r.run: tuple(r)[1:] for r in want.collect()}


def test_saved_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert records.load_state(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('{\n "agent": "codex",\n "initialized": true\n}\n')
    s = records.load_state(spark, str(tmp_path / "s.json"))
    assert s.first().agent == "codex" and s.first().initialized
    records.save_version(s, path, 1)
    records.save_version(s.withColumn("agent", F.lit("")), path, 2)
    assert "agent" not in spark.read.parquet(path).where("version = 2").first().state
    assert records.current_state(spark, path).first().agent is None
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="bad.json"):
        records.load_state(spark, str(tmp_path / "bad.json")).collect()


def calls(spark, rows, **how):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, name string, arguments string")
    return [r for r in tools.check_calls(frame, **how).orderBy("n").collect()]


def test_dispatch(spark):
    got = calls(spark, [("branch_output", "{}"), ("branch_output", '{"branch_id":" branch-123 ","full_output":true}'), ("branch_output", '{"branch_id":"branch-234"}'), ("branch_output", '{"branch_id":"b","full_output":null}'), ("check_status", '{"branch_id":" "}'), ("check_status", '{"branch_id":"b","timeout_seconds":9,"poll_interval_seconds":true}'), ("read_artifact", "[]"), ("execute_agent", '{"agent":"a","prompt":"p","parent_branch_id":"x"}'), ("execute_agent", '{"agent":"a","prompt":"p","parent_branch_id":"x","project_name":"own"}'), (None, "{"), ("zip", "{"), ("zip", None)], default_project=F.lit("home"))
    assert [r.call.problem for r in got] == [tools.NO_BRANCH, None, None, tools.BAD_FLAG, None, None, tools.BAD_JSON + "not an object", None, None, tools.NO_NAME, tools.BAD_JSON + "not JSON", tools.UNSUPPORTED + "zip"]
    assert (got[1].call.branch_id, got[1].call.full_output, got[2].call.full_output, got[4].call.branch_id) == ("branch-123", True, False, " ")
    assert (got[5].call.timeout_seconds, got[5].call.poll_interval_seconds, got[7].call.project, got[8].call.project) == (9.0, None, "home", "own")
    assert json.loads(got[0].error) == {"status": "error", "error": {"message": "`branch_id` is required"}} and got[1].error is None
    assert calls(spark, [("execute_agent", '{"agent":"a","prompt":"p","parent_branch_id":"x"}')])[0].call.problem == tools.MISSING_ARGUMENTS


def test_run_once(spark):
    launches = spark.createDataFrame([(1, '{"branch_id":"b1"}', None), (2, '{"branch_id":"b2"}', None), (3, None, "down"), (4, '{"isError":true}', None), (5, '{"branch_id":"b5"}', None), (6, '{"branch_id":"b6"}', None)], "n int, response string, error string")
    polls = spark.createDataFrame([("b1", '{"status":"finished","output":" short ","manifest":{"summary":"s"}}', None, None), ("b2", None, "Timed out", "FINISHED_WITH_ERROR"), ("b5", '{"status":"finished","output":7,"manifest":{"summary":" s "}}', None, None), ("b6", '{"status":"finished","output":"x"}', None, None)], "branch_id string, answer string, error string, instruction string")
    outputs = spark.createDataFrame([("b1", " ", None), ("b5", None, None), ("b6", None, "reset")], "branch_id string, output string, error string")
    got = {r.n: r for r in tools.run_once(launches, polls, outputs).collect()}
    assert (got[1].result.response, got[1].result.status, got[1].recorded) == ("short", "finished", True) and got[5].result.response == "s"
    assert (got[2].error, got[2].instruction, got[2].recorded) == ("Timed out", "FINISHED_WITH_ERROR", False)
    assert got[3].error == "ParallelExplore failed: down" and got[4].error.startswith("ParallelExplore returned error (details: ")
    assert (got[6].error, got[6].instruction, got[6].recorded) == ("reset", None, True)


def test_deep_and_long_values():
    deep = '{"a":' * 1200 + "1" + "}" * 1200
    assert J.envelope(deep) == deep and J.error_message(deep) == deep
    assert J.branch_id('{"branch":' * 1200 + '{"id":"x"}' + "}" * 1200) == "x" and J.branch_id("[" * 200_000) == ""
    lines = "".join(f"data: {i},\n" for i in range(60_000))
    assert J.event_json("data: {\"a\":[\n" + lines + "data: 0]}\n")[0].count("\n") == 60_001


@given(st.lists(st.sampled_from(['{"a":1}', '{"a":', "1}", "[DONE]", "DONE", "", "x", '"', '"q{"', "\\", "{", "}", "[", "]", "7", "null", '{"s":"}"}', '{"s":"\\"{"', ": c", "event: z", "\0"]), max_size=9))
@settings(max_examples=400, deadline=None)
def test_event_streams_against_repeated_decoding(parts):
    """As the contract says it: after each data line, and at blank ones, the event and then all data are decoded anew."""
    body = "".join("\n" if p == "\0" else (p if p[:2] == ": " or p[:5] == "event" else "data: " + p) + "\n" for p in parts)

    def attempt(data):
        text = "\n".join(data).strip()
        return None if text in ("", "[DONE]", "DONE") else text if J.decode(text)[0] else J.first_value(text)

    current, total, want = [], [], None
    for line in body.split("\n")[:-1]:
        if not line:
            want, current = attempt(current), []
            want = want if want is not None else attempt(total)
        elif line.startswith("data:"):
            current, total = [*current, line[5:].strip()], [*total, line[5:].strip()]
            want = attempt(current)
            want = want if want is not None else attempt(total)
        if want is not None:
            break
    want = want if want is not None else J.first_value(body[:2000])
    assert J.event_json(body)[0] == want


def test_error_payloads():
    assert json.loads(J.error_payload(" ", "", "{}", True)) == {"status": "error", "error": {"message": "tool execution error"}}
    assert json.loads(J.error_payload(None, "I", '{"status":"failed"}', True)) == {"status": "error", "error": {"instruction": "I", "details": {"status": "failed"}}}
    assert json.loads(J.error_payload("404: File or directory not found: /workspace/missing.log", None, None, False))["error"].endswith("missing.log")


def test_settings_and_prompts(spark):
    got = one(spark, S.poll_settings(F.lit(0.0), F.lit(60.0), F.lit(30.0)))
    assert tuple(got) == (21600.0, 60.0, 30.0) and tuple(one(spark, S.poll_settings(F.lit(9.9), F.lit(None).cast("double"), F.lit(300.0), S.CONTROLLER_POLL))) == (9.0, 60.0, 300.0)
    assert tuple(one(spark, S.client_settings(F.lit("http://h//")))) == ("http://h", 30, 3) and one(spark, S.client_settings(F.lit("/")))[0] == S.DEFAULT_URL
    assert one(spark, S.episode_prompt(F.lit(" \n"))) is None and one(spark, S.bootstrap_prompt(["a"], {"b": F.lit(" "), "c": F.lit(" d ")})) == "a\nc=d"
    assert one(spark, S.preview(F.lit("é" * 1500))) == "é" * 1000 and one(spark, S.preview(F.lit("xé"), 2)) == "x\ufffd"
    assert one(spark, J.has_value(F.lit('{"error":null}'), "error")) is False and one(spark, J.has_value(F.lit('{"error":0}'), "error")) is True
    assert one(spark, J.output_text(F.try_parse_json(F.lit('{"output":" x "}')))) == "x" and one(spark, J.output_text(F.try_parse_json(F.lit('{"output":1}')))) == ""


def test_json_details():
    assert J.decode('{"a":1,"a":2}') == (True, {"a": 2}) and not J.decode("NaN")[0] and not J.decode('{"a":1} x')[0]
    assert J.compact({"b": "<&>", "a": [1.0, 1.5, True, None]}) == '{"a":[1,1.5,true,null],"b":"\\u003c\\u0026\\u003e"}'
    assert J.event_json(None)[2] == J.NO_EVENT and J.event_json("data: {\"a\":1}\r\n\r\n")[0] == '{"a":1}'
    assert J.branch_id("nonsense") == "" and J.branch_id(None) == ""


def test_log_templates_have_examples(spark):
    lines = ["2026/01/02 03:04:05.678901 WARN Branch b1 still active (status=running). Sleeping 4.5s.", "2026/01/02 03:04:05.678901 INFO MCP call get_branch failed (attempt 1/5): boom. Retrying in 1s...", "not a log line", "2026/01/02 03:04:05.678901 DEBUG x"]
    got = texts.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string"), least="INFO").collect()
    assert [(r.template_id, r.args) for r in got] == [("still_active", ["b1", "running", "4.5"]), ("rpc_retry", ["get_branch", "1", "5", "boom", "1"])]
