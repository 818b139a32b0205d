"""Log lines, marker protocols and the documented side tables of runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trim_all

# Levels in order, and the line form "yyyy/MM/dd HH:mm:ss.micros LEVEL message".
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
LINE = r"(?s)^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d\.\d{6}) (\w+) (.*)$"
# Message forms, each a pattern with its arguments as groups.
TEMPLATES = [
    ("rebootstrap_clear", r"^Clearing stopped active_episode_branch_id=(\S*) before rebootstrap \(status=(.*)\)\.$"),
    ("bootstrap_required", r"^Bootstrap required \(anchor=(\S*)\)\. Running bootstrap episode\.$"),
    ("max_episodes", r"^Reached max_episodes=(\d+)\. Exiting\.$"),
    ("stop_requested", r"^Stop requested\. Exiting after current episode\.$"),
    ("episode_failed", r"^Episode branch (\S+) failed \(attempt (\d+)/3\)\.$"),
    ("bootstrap_completed", r"^Bootstrap completed\. anchor_branch_id=(\S*)$"),
    ("episode_completed", r"^Episode (\d+) completed\. anchor_branch_id=(\S*)$"),
    ("rpc_post", r"^MCP POST (\S+) attempt (\d+) to (\S+)$"),
    ("rpc_http_error", r"(?s)^MCP HTTP error (\d+) for (\S+) \(CT=(.*?)\): (.*)$"),
    ("sse_preview", r"(?s)^MCP SSE preview: (.*)$"),
    ("sse_unparsed", r"(?s)^Failed to parse SSE JSON for (\S+)\. (.*)$"),
    ("sse_not_json", r"(?s)^MCP SSE payload not JSON \(status (\d+), CT=(.*?)\)\. Preview: (.*)$"),
    ("body_unread", r"(?s)^Failed reading MCP response body for (\S+): (.*) \(bytes=(\d+)\)$"),
    ("body_not_json", r"(?s)^MCP response not JSON \(status (\d+), CT=(.*?)\)\. First 1000 bytes: (.*)$"),
    ("rpc_retry", r"(?s)^MCP call (\S+) failed \(attempt (\d+)/(\d+)\): (.*)\. Retrying in (\d+)s\.\.\.$"),
    ("execute_agent", r"^Executing agent (\S+) on project (.*) from parent (\S*)$"),
    ("waiting", r"^Waiting for branch (\S+) to complete\.$"),
    ("review_missing", r"^review_code attempt (\d+)/(\d+) did not produce (\S+) \(branch=(\S*)\)$"),
    ("check_status", r"^Checking status for branch (\S+) \(timeout=(\d+)s\)$"),
    ("parent_error", r"(?s)^Error getting parent branch (\S+): (.*)$"),
    ("branch_response", r"(?s)^Branch (\S+) response \(attempt (\d+)\): (.*)$"),
    ("still_active", r"^Branch (\S+) still active \(status=(.*)\)\. Sleeping ([\d.]+)s\.$"),
    ("read_artifact", r"^Reading artifact (\S+) from branch (\S+)$"),
    ("branch_output", r"^Retrieving branch_output for (\S+) \(full_output=(true|false)\)$"),
]


def parse_logs(lines: DataFrame, line: str = "value", least: str = "DEBUG") -> DataFrame:
    """``lines`` that are log lines of at least this level: ``ts``, ``level``, ``message``, ``template_id``, ``args``.

    Lines of another form are left out; messages of no known form have a null template and no arguments.
    """
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    rows = lines.withColumn("ts", F.to_timestamp(F.nullif(F.regexp_extract(line, LINE, 1), F.lit("")), "yyyy/MM/dd HH:mm:ss.SSSSSS")).withColumn("level", F.regexp_extract(line, LINE, 2)).withColumn("message", F.regexp_extract(line, LINE, 3))
    rows = rows.where(F.col("ts").isNotNull() & (rank >= LEVELS.index(least) + 1))
    form: Column = F.lit(None).cast("struct<template_id:string,args:array<string>>")
    for key, pattern in reversed(TEMPLATES):
        n = pattern.replace(r"\(", "").replace("(?s)", "").count("(")
        args = F.array(*[F.regexp_extract("message", pattern, i + 1) for i in range(n)]).cast("array<string>")
        # the fixed beginning tells most messages apart without a pattern
        begins = re.match(r"\^?((?:[^\\(^$]|\\[.()])*)", pattern.removeprefix("(?s)"))[1].replace("\\", "")
        hit = F.startswith(F.col("message"), F.lit(begins)) & F.col("message").rlike(pattern)
        form = F.when(hit, F.struct(F.lit(key).alias("template_id"), args.alias("args"))).otherwise(form)
    return rows.withColumn("__form", form).withColumn("template_id", F.col("__form.template_id")).withColumn("args", F.coalesce("__form.args", F.array().cast("array<string>"))).drop("__form")


def marker(text: Column | str, key: str) -> Column:
    """Value of a ``KEY=value`` line; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^{key}=(.*?)[ \t\r]*$", 1), F.lit(""))


def section(text: Column | str, name: str) -> Column:
    """Text between ``BEGIN_name`` and ``END_name`` lines; null without them."""
    return F.nullif(F.regexp_extract(text, rf"(?s)BEGIN_{name}\n(.*?)\nEND_{name}", 1), F.lit(""))


def is_sentinel(text: Column | str, name: str) -> Column:
    return trim_all(text) == name


def unread(notifications: DataFrame, kinds: tuple[str, ...] = ("mention", "reply", "thread_update")) -> DataFrame:
    """Unread notifications of these types, with ``post_id`` and ``comment_id`` (may be null) of their JSON payload."""
    rows = notifications.where(~F.coalesce(F.col("read"), F.lit(False)) & F.col("type").isin(*kinds))
    p = F.from_json("payload", "post_id string, comment_id string")
    return rows.withColumn("post_id", p["post_id"]).withColumn("comment_id", p["comment_id"])


def search_posts(posts: DataFrame, query: str, text: str = "text", project: str | None = None, project_col: str = "project") -> DataFrame:
    found = posts.where(F.contains(F.lower(F.col(text)), F.lit(query.lower())))
    return found if project is None else found.where(F.col(project_col) == project)


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the latest: what upserts of it leave."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first: what writes that skip known keys leave."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def triage(findings: DataFrame, scope: str, severe: Column) -> DataFrame:
    """Findings and severe ones by scope."""
    return findings.groupBy(scope).agg(F.count("*").alias("findings"), F.count_if(severe).alias("severe"))
