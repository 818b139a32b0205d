"""Tool calls and call attempts: dispatch, argument checks, lookups, payloads, retries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext
from ..functions.scalars import first_non_blank, non_blank, retry_wait

# Tools offered, with parameter, type and whether it is required; check_status is answered but not offered.
CATALOGUE = [
    ("execute_agent", "agent", "string", True),
    ("execute_agent", "prompt", "string", True),
    ("execute_agent", "project_name", "string", True),
    ("execute_agent", "parent_branch_id", "string", True),
    ("read_artifact", "branch_id", "string", True),
    ("read_artifact", "path", "string", True),
    ("branch_output", "branch_id", "string", True),
    ("branch_output", "full_output", "boolean", False),
]
ANSWERED = ("execute_agent", "check_status", "read_artifact", "branch_output")
# Agent whose runs must leave a review file, instruction of final errors, and what is said of bad calls.
REVIEW_AGENT, FINISHED = "review_code", "FINISHED_WITH_ERROR"
NO_NAME, BAD_JSON, UNSUPPORTED = "Missing tool name in call.", "Invalid JSON arguments: ", "Unsupported tool: "
MISSING_ARGUMENTS, NO_BRANCH, NO_BRANCH_OR_PATH, BAD_FLAG = "missing required arguments", "`branch_id` is required", "`branch_id` and `path` are required", "`full_output` must be a boolean"
NO_OUTPUT, NO_WORKSPACE = "branch_output returned no textual output", "workspace directory not configured for review_code validation"

CALL = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("problem", "agent", "prompt", "project", "parent_branch_id", "branch_id", "path")]
    + [T.StructField("full_output", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in ("timeout_seconds", "poll_interval_seconds", "max_poll_interval_seconds")]
)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "tool string, param string, type string, required boolean")


def _execute(args: dict, text: Callable[[str], str], project: str) -> tuple[str | None, dict]:
    found = {"agent": text("agent"), "prompt": text("prompt"), "project": text("project_name") or project, "parent_branch_id": text("parent_branch_id")}
    return (None if all(found.values()) else MISSING_ARGUMENTS), found


def _status(args: dict, text: Callable[[str], str], project: str) -> tuple[str | None, dict]:
    numbers = {k: float(v) for k in ("timeout_seconds", "poll_interval_seconds", "max_poll_interval_seconds") if isinstance(v := args.get(k), (int, float)) and not isinstance(v, bool)}
    return (None if text("branch_id") else NO_BRANCH), {"branch_id": text("branch_id"), **numbers}


def _artifact(args: dict, text: Callable[[str], str], project: str) -> tuple[str | None, dict]:
    return (None if text("branch_id") and text("path") else NO_BRANCH_OR_PATH), {"branch_id": text("branch_id"), "path": text("path")}


def _output(args: dict, text: Callable[[str], str], project: str) -> tuple[str | None, dict]:
    branch, flag = text("branch_id").strip(jsontext.SPACE), args.get("full_output", False)
    problem = NO_BRANCH if not branch else BAD_FLAG if not isinstance(flag, bool) else None
    return problem, {"branch_id": branch, "full_output": flag is True}


ANSWERED = {"execute_agent": _execute, "check_status": _status, "read_artifact": _artifact, "branch_output": _output}


def decode_call(name: str | None, arguments: str | None, project: str | None) -> dict:
    """What a tool call asks for, or its ``problem``. Only texts count as text arguments; an empty argument text or null has none."""
    if not name:
        return {"problem": NO_NAME}
    ok, args = jsontext.decode(arguments) if arguments else (True, {})
    if not ok or not isinstance(args, dict | None):
        return {"problem": BAD_JSON + ("not JSON" if not ok else "not an object")}
    if name not in ANSWERED:
        return {"problem": UNSUPPORTED + name}
    args = args or {}
    problem, found = ANSWERED[name](args, lambda k: v if isinstance(v := args.get(k), str) else "", project or "")
    return {"problem": problem, **({} if problem else found)}


@F.arrow_udf(CALL)
def _decoded(name: pa.Array, arguments: pa.Array, project: pa.Array) -> pa.Array:
    rows = [decode_call(*r) for r in zip(name.to_pylist(), arguments.to_pylist(), project.to_pylist(), strict=True)]
    return pa.array(rows, type=pa.struct([(f.name, pa.bool_() if f.name == "full_output" else pa.float64() if f.name.endswith("seconds") else pa.string()) for f in CALL]))


def check_calls(calls: DataFrame, name: str = "name", arguments: str = "arguments", default_project: Column | None = None) -> DataFrame:
    """``calls`` with the struct ``call``: its ``problem`` (null if it can be dispatched) and its arguments, and ``error``, the payload that answers a problem."""
    project = F.lit(None).cast("string") if default_project is None else default_project
    rows = calls.withColumn("call", _decoded(name, arguments, project))
    none = F.lit(None).cast("string")
    return rows.withColumn("error", F.when(F.col("call.problem").isNotNull(), jsontext.json_error_payload("call.problem", none, none, F.lit(True))))


def run_once(launches: DataFrame, polls: DataFrame, outputs: DataFrame, key: str = "n") -> DataFrame:
    """A run of an agent from recorded answers: one row per launch with its result record, or the ``error`` that ends it.

    ``launches(key, response, error)`` hold a launch's answer (JSON) or why it failed,
    ``polls(branch_id, answer, error, instruction)`` the decisive status answer of a branch or
    why there is none, ``outputs(branch_id, output, error)`` its output. The steps fail in this
    order: launch, its error flag, its branch id, status, output, no text at all. The record
    holds the launch's answer, branch id, status answer, status and response; ``recorded`` says
    whether the branch counts as reached, which needs only the status.
    """
    v = F.try_parse_json("response")
    flagged = F.coalesce(jsontext.typed(v, "$.isError", "BOOLEAN"), F.lit(False))
    rows = launches.select(key, "response", F.col("error").alias("__launch"), jsontext.json_branch_id("response").alias("branch_id"), flagged.alias("__flagged"), jsontext.has_value("response", "error").alias("__told"))
    rows = rows.join(polls.select("branch_id", F.col("answer").alias("branch"), F.col("error").alias("__poll"), "instruction"), "branch_id", "left")
    rows = rows.join(outputs.select("branch_id", F.col("output").alias("__output"), F.col("error").alias("__unread")), "branch_id", "left")
    s = F.try_parse_json("branch")
    texts = (F.col("__output"), jsontext.typed(s, "$.output", "STRING"), jsontext.typed(s, "$.manifest.summary", "STRING"))
    told = F.concat(F.lit("ParallelExplore returned error: "), F.get_json_object("response", "$.error"))
    message = (
        F.when(F.col("__launch").isNotNull(), F.concat(F.lit("ParallelExplore failed: "), "__launch"))
        .when(F.col("__flagged"), F.when(F.col("__told"), told).otherwise(F.concat(F.lit("ParallelExplore returned error (details: "), "response", F.lit(")"))))
        .when(F.coalesce("branch_id", F.lit("")) == "", F.concat(F.lit("Missing branch id in parallel_explore response: "), F.coalesce("response", F.lit(""))))
        .when(F.col("__poll").isNotNull(), F.col("__poll"))
        .when(F.col("__unread").isNotNull(), F.col("__unread"))
        .when(first_non_blank(*texts) == "", F.lit(NO_OUTPUT))
    )
    early = F.col("__launch").isNotNull() | F.col("__flagged") | (F.coalesce("branch_id", F.lit("")) == "")
    rows = rows.withColumn("error", message).withColumn("recorded", ~early & F.col("__poll").isNull())
    final = F.when(F.col("error").isNotNull() & ~F.col("recorded"), F.coalesce(F.nullif("instruction", F.lit("")), F.lit(FINISHED)))
    record = F.struct(F.col("response").alias("parallel_explore"), "branch_id", "branch", jsontext.typed(s, "$.status", "STRING").alias("status"), first_non_blank(*texts).alias("response"))
    return rows.select(key, F.when(F.col("error").isNull(), record).alias("result"), "error", final.alias("instruction"), "recorded")


def response_text(rows: DataFrame, output: str, status_output: str, summary: str, out: str = "response") -> DataFrame:
    """First of branch output, status output and manifest summary with text in it, trimmed; ``error`` where there is none."""
    text = F.coalesce(non_blank(output), non_blank(status_output), non_blank(summary))
    return rows.withColumn(out, text).withColumn("error", F.when(text.isNull(), F.lit("branch has no output")))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str, error: str = "404: not found") -> DataFrame:
    """Left lookup of recorded artifacts or outputs by their keys, with ``error`` where there is no record."""
    known = table.select(*keys, F.col(value), F.lit(True).alias("__known"))
    return rows.join(known, keys, "left").withColumn("error", F.when(F.col("__known").isNull(), F.lit(error))).drop("__known")


def call_attempts(attempts: DataFrame, call: str = "call", attempt: str = "attempt", ok: str = "ok", body_error: str = "body_error", most: int = 3) -> DataFrame:
    """Per call: attempts made, the one that succeeded (null if none), and the waits between them in seconds.

    Attempts count from 0. A failed attempt is followed by a wait of 2 ** attempt seconds, but
    not the last one, and not one whose body could not be read. One aggregate, combined before
    its shuffle: what comes after the success is taken off by the number of attempts kept.
    """
    waits = F.when(~F.col(ok) & ~F.coalesce(F.col(body_error), F.lit(False)) & (F.col(attempt) < most - 1), retry_wait(attempt)).otherwise(F.lit(0))
    made = F.collect_list(F.struct(F.col(attempt).alias("a"), waits.cast("long").alias("w")))  # at most ``most`` of each number
    per = attempts.where(F.col(attempt) < most).groupBy(call).agg(F.min(F.when(F.col(ok), F.col(attempt))).alias("succeeded_at"), made.alias("__made"))
    kept = F.filter("__made", lambda x: F.col("succeeded_at").isNull() | (x["a"] <= F.col("succeeded_at")))
    return per.select(call, F.size(kept).cast("long").alias("attempts"), "succeeded_at", F.aggregate(kept, F.lit(0).cast("long"), lambda t, x: t + x["w"]).alias("waited_s"))
