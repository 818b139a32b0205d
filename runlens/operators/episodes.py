"""The episode state machine over recorded steps: start checks, transitions, and the state each run ends in.

A step is one turn of a run's loop as it was recorded: what the launch, the polls and the output
of its branch gave. ``transition`` is the machine for one step; ``steps`` and ``final_states``
say the same for whole tables with window functions, all in one order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.jsontext import SPACE
from ..functions.scalars import FAILURE_PAUSE_S, MAX_FAILURES, is_terminal, missing_branch, non_blank, status_of, trim_all

STEP = "run string, seq long, stop boolean, launch_error string, is_error boolean, branch string, poll string, output_error string, output string, stop_after boolean"
RUN = "run string, anchor string, parent string, active string, initialized boolean, rebootstrap boolean, project string, max_episodes long"
#: How a step may end; all but the last three end the run, and failed does at the third in a row or if it is stopped.
OUTCOMES = ("stop", "launch_error", "launch_rejected", "missing_branch", "poll_error", "output_error", "blank_output", "failed", "success")
# What is said of runs that can't start.
NO_PROJECT, NO_PARENT, STILL_RUNNING = "project_name is required", "parent_branch_id is required for first run", "cannot rebootstrap with an active episode branch still running"


def outcome_of(resumed: Column) -> Column:
    """Which of ``OUTCOMES`` a step has. A resumed step launches nothing; ``poll`` is success, failed (final) or any other text."""
    launch = F.when(F.col("launch_error").isNotNull(), "launch_error").when(F.coalesce("is_error", F.lit(False)), "launch_rejected").when(non_blank("branch").isNull(), "missing_branch")
    after = F.when(F.col("poll") == "failed", "failed").when(F.coalesce(F.col("poll") != "success", F.lit(True)), "poll_error").when(F.col("output_error").isNotNull(), "output_error").when(non_blank("output").isNull(), "blank_output").otherwise("success")
    return F.when(F.coalesce("stop", F.lit(False)), "stop").otherwise(F.coalesce(F.when(~resumed, launch), after))


def still_running(lookups: DataFrame, parents: DataFrame) -> DataFrame:
    """``lookups(run, branch, error, payload_error, status, latest_snap_id, parent_id)`` with ``running``, ``status`` and ``problem``, as a rebootstrap asks.

    A failed lookup is a problem; an answered error is one too, unless it says not found, which
    is not running. Else a branch has stopped if its status is terminal and its snapshot is its
    own: a parent that can't be looked up, answers with an error (``parents(id, error,
    payload_error, latest_snap_id)``) or has the same snapshot makes it count as running.
    """
    p = parents.select(F.col("id").alias("__id"), (F.coalesce(F.col("error"), F.lit(False)) | F.coalesce(F.col("payload_error"), F.lit(False))).alias("__bad"), F.coalesce(status_of("latest_snap_id"), F.lit("")).alias("__snap"))
    rows = lookups.join(p, status_of("parent_id") == F.col("__id"), "left")
    same = (F.col("__snap") != "") & (F.col("__snap") == F.coalesce(status_of("latest_snap_id"), F.lit("")))
    own = F.col("__id").isNull() | ~(F.col("__bad") | same)
    gone = missing_branch("payload_error")
    problem = F.coalesce(F.col("error"), F.when(F.col("payload_error").isNotNull() & ~gone, F.concat(F.lit("GetBranch returned error: "), "payload_error")))
    running = ~(gone | (own & is_terminal("status")))
    status = F.when(gone, "not_found").otherwise(F.coalesce(status_of("status"), F.lit("")))
    return rows.select("run", "branch", F.when(problem.isNull(), running).alias("running"), F.when(problem.isNull(), status).alias("status"), problem.alias("problem"))


def start(runs: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """``runs`` as their loop begins, with ``bootstrap`` (whether one is needed) and ``error`` for those that can't start.

    ``lookups(run, running, status, problem)``, as ``still_running`` gives it, is asked for runs
    that rebootstrap with an active branch: one still running is an error, a stopped one is
    cleared. Then a project is required, then an anchor, for which the parent serves if there is
    none.
    """
    text = lambda c: F.coalesce(trim_all(c), F.lit(""))
    rows = runs
    for c in ("anchor", "parent", "active", "project"):
        rows = rows.withColumn(c, text(c))
    rows = rows.withColumn("rebootstrap", F.coalesce("rebootstrap", F.lit(False))).withColumn("initialized", F.coalesce("initialized", F.lit(False))).withColumn("max_episodes", F.coalesce("max_episodes", F.lit(0)))
    asks = F.col("rebootstrap") & (F.col("active") != "")
    if lookups is None:
        rows = rows.withColumn("__running", F.lit(False)).withColumn("__status", F.lit("")).withColumn("__problem", F.lit(None).cast("string"))
    else:
        rows = rows.join(lookups.select("run", F.col("running").alias("__running"), F.col("status").alias("__status"), F.col("problem").alias("__problem")), "run", "left")
    running = F.concat(F.lit(STILL_RUNNING + " (active_episode_branch_id="), "active", F.lit(")"), F.when(F.coalesce("__status", F.lit("")) != "", F.concat(F.lit(" (status="), "__status", F.lit(")"))).otherwise(""))
    error = (
        F.when(asks & F.col("__problem").isNotNull(), F.concat(F.lit("check active episode branch "), "active", F.lit(" before rebootstrap: "), "__problem"))
        .when(asks & F.coalesce("__running", F.lit(False)), running)
        .when(F.col("project") == "", NO_PROJECT)
        .when((F.col("anchor") == "") & (F.col("parent") == ""), NO_PARENT)
    )
    rows = rows.withColumn("error", error).withColumn("active", F.when(asks & F.col("error").isNull(), "").otherwise(F.col("active")))
    rows = rows.withColumn("anchor", F.when((F.col("anchor") == "") & F.col("error").isNull(), F.col("parent")).otherwise(F.col("anchor")))
    return rows.withColumn("bootstrap", F.col("rebootstrap") | ~F.col("initialized")).drop("__running", "__status", "__problem")


def steps(recorded: DataFrame, started: DataFrame, limit: int = MAX_FAILURES) -> DataFrame:
    """The steps that take place: ``run``, ``seq``, ``branch``, ``outcome``, ``parent``, ``anchor``, ``active``, ``streak``, ``episode_no``, ``launched``, ``sleep_s``, ``ends``.

    ``recorded`` has the columns of ``STEP``, ``started`` is as from ``start``. Runs that can't
    start have none. Steps after the one that ends a run, and after the last episode it may
    have, don't take place. ``parent`` is the anchor a step was launched from, ``anchor`` the one
    after it; a branch stays active where it may be resumed.
    """
    order = Window.partitionBy("run").orderBy("seq")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    begun = started.where("error is null").select("run", F.col("anchor").alias("__anchor"), F.col("active").alias("__active"), "bootstrap", "max_episodes")
    rows = recorded.join(begun, "run").withColumn("__n", F.row_number().over(order))
    resumed = (F.col("__n") == 1) & (F.col("__active") != "")
    rows = rows.withColumn("outcome", outcome_of(resumed)).withColumn("branch", F.when(resumed, F.col("__active")).otherwise(F.coalesce(trim_all("branch"), F.lit(""))))
    good = F.col("outcome") == "success"
    rows = rows.withColumn("__good", F.count_if(good).over(so_far)).withColumn("__last", F.coalesce(F.max(F.when(good, F.col("__n"))).over(so_far), F.lit(0)))
    rows = rows.withColumn("parent", F.coalesce(F.last(F.when(good, F.col("branch")), ignorenulls=True).over(before), F.col("__anchor")))
    boot = F.col("bootstrap").cast("int")
    failed = F.col("outcome") == "failed"
    rows = rows.withColumn("streak", F.when(good, 0).otherwise(F.col("__n") - F.col("__last") - F.when(failed, 0).otherwise(1)).cast("long"))
    stopped = F.coalesce("stop_after", F.lit(False))
    ends = ~good & ~(failed & (F.col("streak") < limit) & ~stopped)
    full = (F.col("max_episodes") > 0) & (F.col("__good") - good.cast("int") - boot >= F.col("max_episodes"))
    rows = rows.withColumn("ends", ends).withColumn("__gone", full | F.coalesce(F.max("ends").over(before), F.lit(False))).where("not __gone")
    held = F.col("outcome").isin("poll_error", "output_error", "blank_output")
    waiting = F.when(held, F.col("branch")).when(resumed & (F.col("outcome") == "stop"), F.col("__active")).otherwise("")
    return rows.select(
        "run",
        "seq",
        F.when(F.col("outcome").isin("stop", "launch_error", "launch_rejected", "missing_branch"), F.when(resumed, F.col("branch")).otherwise("")).otherwise(F.col("branch")).alias("branch"),
        "outcome",
        "parent",
        F.when(good, F.col("branch")).otherwise(F.col("parent")).alias("anchor"),
        waiting.alias("active"),
        "streak",
        F.when(good & (F.col("__good") > boot), F.col("__good") - boot).cast("long").alias("episode_no"),
        (~resumed & ~F.col("outcome").isin("stop", "launch_error")).alias("launched"),
        F.when(failed & ~stopped, FAILURE_PAUSE_S).otherwise(0).alias("sleep_s"),
        "ends",
    )


def final_states(taken: DataFrame, started: DataFrame) -> DataFrame:
    """The state in which each run ends: ``run``, ``anchor``, ``active``, ``initialized``, ``bootstrap_branch``, ``episodes``, ``launches``, ``streak``, ``slept_s``, ``error``.

    ``taken`` is as from ``steps``. Errors of runs that can't start are theirs; a run that ended
    otherwise than by a stop has its last step's outcome as error. One aggregate over the steps,
    combined before its shuffle, joined to one row a run.
    """
    good, last = F.col("outcome") == "success", lambda c: F.max_by(c, "seq")
    failing = F.when(F.col("ends") & ~((F.col("outcome") == "stop") | ((F.col("outcome") == "failed") & (F.col("sleep_s") == 0))), F.col("outcome"))
    per = taken.groupBy("run").agg(
        last("anchor").alias("__anchor"), last("active").alias("__active"), F.min_by("branch", F.when(good, F.col("seq"))).alias("__first"),
        F.max("episode_no").alias("__episodes"), F.count_if("launched").alias("__launches"), last("streak").alias("__streak"), F.sum("sleep_s").alias("__slept"), last(failing).alias("__error"),
    )
    rows = started.join(per, "run", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    booted = F.col("bootstrap") & F.col("__first").isNotNull()
    return rows.select(
        "run",
        F.coalesce("__anchor", "anchor").alias("anchor"),
        F.coalesce("__active", "active").alias("active"),
        (F.col("initialized") | booted).alias("initialized"),
        F.when(booted, F.col("__first")).alias("bootstrap_branch"),
        zero("__episodes").alias("episodes"),
        zero("__launches").alias("launches"),
        zero("__streak").alias("streak"),
        zero("__slept").alias("slept_s"),
        F.coalesce("error", "__error").alias("error"),
    )


#: State of a run: anchor, active, initialized, bootstrap still needed, bootstrap branch, episodes, launches, streak, slept seconds, error, ended.
State = tuple[str, str, bool, bool, str | None, int, int, int, int, str | None, bool]


def transition(state: State, step: dict, max_episodes: int = 0, limit: int = MAX_FAILURES) -> State:
    """The state after one step, as columns of ``STEP``; an ended run's state stays."""
    anchor, active, initialized, boot, first, episodes, launches, streak, slept, error, ended = state
    if ended or max_episodes and episodes >= max_episodes:
        return (*state[:-1], True)
    if step.get("stop"):
        return (*state[:-1], True)
    branch = active
    if not branch:
        if step.get("launch_error") is not None:
            return (*state[:-2], "launch_error", True)
        launches += 1
        branch = (step.get("branch") or "").strip(SPACE)
        bad = "launch_rejected" if step.get("is_error") else "missing_branch" if not branch else None
        if bad:
            return anchor, active, initialized, boot, first, episodes, launches, streak, slept, bad, True
    if step.get("poll") == "failed":
        streak += 1
        over = bool(step.get("stop_after"))
        slept += 0 if over else FAILURE_PAUSE_S
        halted = streak >= limit and not over
        return anchor, "", initialized, boot, first, episodes, launches, streak, slept, "failed" if halted else None, halted or over
    held = "poll_error" if step.get("poll") != "success" else "output_error" if step.get("output_error") is not None else "blank_output" if not (step.get("output") or "").strip(SPACE) else None
    if held:
        return anchor, branch, initialized, boot, first, episodes, launches, streak, slept, held, True
    return branch, "", True, False, branch if boot else first, episodes + (not boot), launches, 0, slept, None, False
