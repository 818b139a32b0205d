"""Ordered computations over the attempts of recorded runs: anchors, streaks, halts, limits, lineage, polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import FAILURE_PAUSE_S, MAX_FAILURES, is_terminal, missing_artifact, non_blank, status_of
from ..sources.scratch import written


def _before(run: str, order: list[str]) -> Window:
    return Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(run: str, order: list[str]) -> Window:
    return Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def last_anchor(attempts: DataFrame, run: str, branch: str, success: Column, order: Column) -> DataFrame:
    """One row per run: the last successful branch (null if none). One shuffle, combined before it."""
    return attempts.groupBy(run).agg(F.max_by(F.when(success, F.col(branch)), F.when(success, order)).alias("anchor"))


def tracker_range(attempts: DataFrame, run: str, branch: str, success: Column, order: Column, seed: Column | None = None) -> DataFrame:
    """First and last non-empty successful branch of each run; a seed stands before the first."""
    ok = success & F.col(branch).isNotNull()
    low, high = (f(F.when(ok, F.col(branch)), F.when(ok, order)) for f in (F.min_by, F.max_by))
    seeded = (F.coalesce(seed, low), F.coalesce(high, seed)) if seed is not None else (low, high)
    return attempts.groupBy(run).agg(seeded[0].alias("start"), seeded[1].alias("latest"))


def with_anchor(attempts: DataFrame, run: str, branch: str, success: Column, order: list[str], initial: Column, out: str = "anchor") -> DataFrame:
    """Each attempt with the anchor it was launched from: the last success strictly before it, else the initial parent."""
    return attempts.withColumn(out, F.coalesce(F.last(F.when(success, F.col(branch)), ignorenulls=True).over(_before(run, order)), initial))


def with_streak(attempts: DataFrame, run: str, failed: Column, order: list[str], out: str = "streak") -> DataFrame:
    """Each attempt with the number of failures in a row up to it; a success is 0 and starts anew."""
    island = attempts.withColumn("__island", F.sum(F.when(failed, 0).otherwise(1)).over(_so_far(run, order)))
    within = Window.partitionBy(run, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn(out, F.coalesce(F.sum(F.when(failed, 1).otherwise(0)).over(within), F.lit(0)).cast("long")).drop("__island")


def until_halt(attempts: DataFrame, run: str, failed: Column, order: list[str], limit: int = MAX_FAILURES) -> DataFrame:
    """Attempts up to and including the one that reaches ``limit`` failures in a row, with ``streak`` and ``sleep_s``."""
    rows = with_streak(attempts, run, failed, order)
    done = F.coalesce(F.sum(F.when(F.col("streak") >= limit, 1).otherwise(0)).over(_before(run, order)), F.lit(0))
    rows = rows.withColumn("__done", done).where("__done = 0").drop("__done")
    return rows.withColumn("sleep_s", F.when(failed, F.lit(FAILURE_PAUSE_S)).otherwise(F.lit(0)))


def up_to_episode(attempts: DataFrame, run: str, success: Column, order: list[str], most: int, bootstrap: Column | None = None) -> DataFrame:
    """Completed episodes, numbered per run, up to ``most`` (0: all); bootstrap runs don't count."""
    counted = success if bootstrap is None else success & ~bootstrap
    numbered = attempts.where(counted).withColumn("episode_no", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long"))
    return numbered.where(F.lit(most == 0) | (F.col("episode_no") <= most))


def numbered(rows: DataFrame, run: str, order: list[str], out: str = "attempt_no") -> DataFrame:
    """Each row with its number within its run, from 1: attempts, polls or request ids."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long"))


def episode_counts(attempts: DataFrame, run: str, success: Column, bootstrap: Column) -> DataFrame:
    """Attempts and completed episodes of each run; bootstrap runs don't count as episodes."""
    return attempts.groupBy(run).agg(F.count("*").alias("attempts"), F.count_if(success & ~bootstrap).alias("episodes"))


def launching(attempts: DataFrame, run: str, left_active: Column, order: list[str]) -> DataFrame:
    """Attempts that launch a branch: those before which none was left active to be resumed."""
    active = F.coalesce(F.lag(left_active).over(Window.partitionBy(run).orderBy(*order)), F.lit(False))
    return attempts.withColumn("__active", active).where("not __active").drop("__active")


def freshness(children: DataFrame, parents: DataFrame, child_parent: str, parent_id: str, snap: str, mode: str = "poll") -> DataFrame:
    """Children with ``fresh``: whether their snapshot is their own and not taken over from the parent.

    ``parents`` may have ``error`` (lookup failed in transport) and ``payload_error`` (it was
    answered with an error). In mode ``poll`` an answered error leaves the child fresh, in
    ``rebootstrap`` it doesn't; a failed lookup never does. Ids and snapshots are compared
    trimmed and in lower case. One equi-join; Spark picks how.
    """
    p = parents.select(F.col(parent_id).alias("__pid"), F.coalesce(status_of(snap), F.lit("")).alias("__psnap"), *[F.coalesce(F.col(c), F.lit(False)).alias("__" + c) if c in parents.columns else F.lit(False).alias("__" + c) for c in ("error", "payload_error")])
    joined = children.join(p, status_of(child_parent) == F.col("__pid"), "left")
    same = (F.col("__psnap") != "") & (F.col("__psnap") == F.coalesce(status_of(snap), F.lit("")))
    answered = F.lit(mode == "poll")
    fresh = F.when(F.col("__pid").isNull(), True).when(F.col("__error"), False).when(F.col("__payload_error"), answered).otherwise(~same)
    return joined.withColumn("fresh", fresh).drop("__pid", "__psnap", "__error", "__payload_error")


def lineage(spark: SparkSession, edges: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, root, depth)`` of every node of a parent forest, by pointer doubling; roots have no known parent.

    Each round doubles how far a node sees, so a chain of n nodes takes log2(n) rounds, each a
    join of written tables; nodes that have found their root are set aside. Nodes of a cycle,
    and below one, have no root: both are null. Nodes are distinct, null ones are left out.
    """
    known = edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null")
    up = known.join(known.select(F.col("node").alias("parent"), F.lit(True).alias("__known")), "parent", "left")
    up = up.select("node", F.when(F.col("__known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("far"))
    todo, done = written(up, "lineage"), []
    done.append(todo.where("up is null").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth")))
    todo, left = todo.where("up is not null"), None
    found = done[0]
    while (now := todo.count()) and now != left:
        # a node whose ancestor has its root set aside is done; the others see twice as far
        ends = found.select(F.col("node").alias("up"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        reach = todo.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("far").alias("__far"))
        moved = todo.join(ends, "up", "left").join(reach, "up", "left")
        moved = written(moved.select("node", F.coalesce("__up", "up").alias("up"), (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far"), F.col("__root").alias("root"), (F.col("far") + F.col("__depth")).alias("depth")), "lineage")
        found = moved.where("root is not null").select("node", "root", "depth")
        done.append(found)
        found, left = _union(done), now
        todo = moved.where("root is null").select("node", "up", "far")
    lost = todo.select("node", F.lit(None).cast(known.schema["node"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"))
    return _union([*done, lost])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def first_timeout(polls: DataFrame, run: str, order: list[str], wait: Column, terminal: Column, timeout: float) -> DataFrame:
    """First poll of each run at which the waits before it exceed the timeout and its status is not terminal."""
    elapsed = polls.withColumn("elapsed", F.coalesce(F.sum(wait).over(_before(run, order)), F.lit(0.0)))
    late = elapsed.where((F.col("elapsed") > timeout) & ~terminal)
    return late.withColumn("__n", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where("__n = 1").drop("__n")


def poll_outcome(polls: DataFrame, branch: str = "branch_id", poll_no: str = "poll_no", timeout: float = 21600.0) -> DataFrame:
    """One decisive row per branch: get error, error payload, missing id, fresh terminal status, time-out, in that order within a poll.

    ``polls`` has ``get_error``, ``has_error``, ``id``, ``status``, ``fresh``, ``elapsed``.
    """
    terminal = is_terminal("status") & F.coalesce(F.col("fresh"), F.lit(True))
    what = F.when(F.col("get_error").isNotNull(), "get_error").when(F.coalesce(F.col("has_error"), F.lit(False)), "error_payload").when(non_blank("id").isNull(), "missing_id").when(terminal & (status_of("status") == "failed"), "failed").when(terminal, "success").when(F.col("elapsed") > timeout, "timeout")
    found = polls.withColumn("outcome", what).where("outcome is not null")
    return found.groupBy(branch).agg(F.min_by("outcome", poll_no).alias("outcome"), F.min(poll_no).alias("decided_at"), F.min_by("status", poll_no).alias("status"))


def review_result(attempts: DataFrame, most: int = 3, review: str = "review", attempt: str = "attempt", message: str = "error") -> DataFrame:
    """One row per review: the first attempt that didn't end in a missing artifact, or exhausted after ``most``."""
    tried = attempts.where(F.col(attempt) <= most).withColumn("__missing", missing_artifact(message))
    hit = F.when(~F.col("__missing"), F.col(attempt))
    out = tried.groupBy(review).agg(F.min(hit).alias("decided_at"), F.count("*").alias("tried"), F.min_by(message, hit).alias("error"), F.min_by("content", hit).alias("content"))
    result = F.when(F.col("decided_at").isNull(), "exhausted").when(F.col("error").isNotNull(), "error").otherwise("done")
    return out.select(review, result.alias("result"), F.coalesce("decided_at", "tried").cast("long").alias("attempts"), non_blank("content").alias("review_report"))
