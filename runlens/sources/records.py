"""Readers and writers of recorded runs: state files, call answers, log lines, state versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import json_envelope, sse_first_json

# Fields of the saved state that the engine reads; other text fields are named by the caller.
STATE = "mcp_base_url string, rpc_url string, project_name string, agent string, task string, agents_md_url string, skills_url string, project_collaboration_md_url string, anchor_branch_id string, bootstrap_branch_id string, active_episode_branch_id string, initialized boolean"
DEFAULT_STATE = "controller_state.json"


def _schema(more: tuple[str, ...]) -> str:
    return ", ".join([STATE, *(f"{c} string" for c in more)])


def load_state(spark: SparkSession, path: str = DEFAULT_STATE, more: tuple[str, ...] = ()) -> DataFrame:
    """One saved state; no row if the file is missing, an error naming it if it is malformed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _schema(more))
    return spark.read.schema(_schema(more)).json(path, multiLine=True, mode="FAILFAST")


def save_version(state: DataFrame, path: str, version: int, key: str | None = None) -> None:
    """Append one version of the state, of each ``key`` if given; empty texts and false are left out, as in the saved file.

    A version is one write, which its readers see whole or not at all; the last one counts.
    """
    fields = [F.when(F.col(c) != F.lit(False if kind == "boolean" else ""), F.col(c)).alias(c) for c, kind in state.dtypes if c != key]
    keys = [F.col(key)] if key else []
    state.select(*keys, F.lit(version).cast("long").alias("version"), F.to_json(F.struct(*fields)).alias("state")).write.mode("append").parquet(path)


def current_state(spark: SparkSession, path: str, more: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """The state of the highest version, of each ``key`` if given."""
    last = spark.read.parquet(path).groupBy(*([key] if key else [])).agg(F.max_by("state", "version").alias("state"))
    return last.select(*([key] if key else []), F.from_json("state", _schema(more)).alias("s")).select(*([key] if key else []), "s.*")


def answers(responses: DataFrame, status: str = "http_status", content_type: str = "content_type", body: str = "body") -> DataFrame:
    """Recorded call answers with ``kind`` (http_error, sse, json), ``payload`` (normalised envelope) and ``problem``."""
    kind: Column = F.when(~F.col(status).between(200, 299), "http_error").when(F.contains(F.lower(F.coalesce(F.col(content_type), F.lit(""))), F.lit("text/event-stream")), "sse").otherwise("json")
    rows = responses.withColumn("kind", kind).withColumn("__sse", sse_first_json(F.when(F.col("kind") == "sse", F.col(body)).otherwise(F.lit(""))))
    text = F.when(F.col("kind") == "sse", F.col("__sse.json")).when(F.col("kind") == "json", F.col(body))
    rows = rows.withColumn("payload", json_envelope(text))
    problem = F.when(F.col("kind") == "http_error", F.concat(F.lit("HTTP "), F.col(status).cast("string"))).when((F.col("kind") == "sse") & F.col("__sse.json").isNull(), F.col("__sse.error")).when(F.col("payload").isNull(), "response is not a JSON object")
    return rows.withColumn("problem", problem).drop("__sse")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
