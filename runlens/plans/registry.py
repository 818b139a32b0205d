"""Registered queries over the test tables, each with the same question in SQL.

The tables hold no runs, so every operator is exercised on a table of the same shape; the
mapping is stated with each query. In ``events`` a user is a run, an event an attempt or poll
(ordered by ts and id), and an ``error`` event a failed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsontext as J
from ..functions import scalars as S
from ..operators import episodes, runs, texts, tools
from ..sources import records, scratch
from ..streaming import controller

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: run, branch, ts, failed."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("branch"), "ts", (F.col("event_type") == "error").alias("failed"))


_ORDER = ["ts", "branch"]
_A = "WITH a AS (SELECT user_id AS run, event_id AS branch, ts, event_type = 'error' AS failed FROM events) "


# -- anchors, streaks, limits: events ------------------------------------------------------------


@query(_A + "SELECT run, arg_max(branch, (ts, branch)) FILTER (WHERE NOT failed) AS anchor FROM a GROUP BY run")
def anchor_promotion(spark, sf_dir):
    return runs.last_anchor(attempts(spark, sf_dir), "run", "branch", ~F.col("failed"), F.struct("ts", "branch"))


@query(_A + "SELECT run, arg_min(branch, (ts, branch)) FILTER (WHERE NOT failed) AS start, arg_max(branch, (ts, branch)) FILTER (WHERE NOT failed) AS latest FROM a GROUP BY run")
def tracker_range(spark, sf_dir):
    return runs.tracker_range(attempts(spark, sf_dir), "run", "branch", ~F.col("failed"), F.struct("ts", "branch"))


@query(_A + "SELECT run, branch, coalesce(last_value(CASE WHEN NOT failed THEN branch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY ts, branch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS anchor FROM a")
def anchor_before_attempt(spark, sf_dir):
    return runs.with_anchor(attempts(spark, sf_dir), "run", "branch", ~F.col("failed"), _ORDER, F.lit(-1).cast("long")).select("run", "branch", "anchor")


_STREAK = "s AS (SELECT run, branch, ts, failed, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run, g ORDER BY ts, branch) AS BIGINT) AS streak FROM (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY ts, branch) AS g FROM a)) "


@query(_A + ", " + _STREAK + "SELECT run, branch, streak FROM s")
def failure_streak(spark, sf_dir):
    return runs.with_streak(attempts(spark, sf_dir), "run", F.col("failed"), _ORDER).select("run", "branch", "streak")


@query(_A + ", " + _STREAK + "SELECT run, branch, streak, CASE WHEN failed THEN 1200 ELSE 0 END AS sleep_s FROM (SELECT *, coalesce(sum(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, branch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s) WHERE done = 0")
def halt_after_three(spark, sf_dir):
    return runs.until_halt(attempts(spark, sf_dir), "run", F.col("failed"), _ORDER).select("run", "branch", "streak", "sleep_s")


@query(_A + "SELECT run, branch, n AS episode_no FROM (SELECT run, branch, row_number() OVER (PARTITION BY run ORDER BY ts, branch) AS n FROM a WHERE NOT failed) WHERE n <= 5")
def episode_limit(spark, sf_dir):
    return runs.up_to_episode(attempts(spark, sf_dir), "run", ~F.col("failed"), _ORDER, 5).select("run", "branch", "episode_no")


@query("SELECT user_id AS run, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(CASE WHEN event_type <> 'error' AND event_type <> 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS episodes FROM events GROUP BY user_id")
def episode_counts(spark, sf_dir):
    """Attempts and completed episodes per run; signup stands for bootstrap."""
    e = table(spark, sf_dir, "events")
    return runs.episode_counts(e.withColumnRenamed("user_id", "run"), "run", F.col("event_type") != "error", F.col("event_type") == "signup")


@query(_A + "SELECT run, branch, row_number() OVER (PARTITION BY run ORDER BY ts, branch) AS attempt_no FROM a")
def attempt_numbers(spark, sf_dir):
    return runs.numbered(attempts(spark, sf_dir), "run", _ORDER).select("run", "branch", "attempt_no")


@query(_A + "SELECT run, branch FROM (SELECT run, branch, coalesce(lag(failed) OVER (PARTITION BY run ORDER BY ts, branch), FALSE) AS active FROM a) WHERE NOT active")
def new_launches(spark, sf_dir):
    """Attempts that launch: those before which no branch is active (a failed attempt stands for one left active)."""
    return runs.launching(attempts(spark, sf_dir), "run", F.col("failed"), _ORDER).select("run", "branch")


@query("""
WITH RECURSIVE w(k, n, wait) AS (
  SELECT o_orderkey, 1, CAST(1 + o_orderkey % 60 AS DOUBLE) FROM orders
  UNION ALL SELECT k, n + 1, CAST(floor(least(floor(wait) * 1.5, 300)) AS DOUBLE) FROM w WHERE n < 7)
SELECT k AS o_orderkey, CAST(n AS INTEGER) AS poll_no, wait AS wait_s FROM w
""")
def poll_backoff(spark, sf_dir):
    """Waits of seven polls; an order seeds a first wait of 1 to 60 seconds."""
    waits = S.backoff_waits((F.lit(1) + F.col("o_orderkey") % 60), F.lit(300), 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(waits).alias("n", "wait_s")).select("o_orderkey", (F.col("n") + 1).alias("poll_no"), "wait_s")


@query("""
WITH a AS (SELECT user_id AS run, event_id AS poll, ts, value, event_type, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS elapsed FROM (SELECT user_id, event_id, ts, floor(value) AS value, event_type FROM events))
SELECT run, poll FROM (SELECT run, poll, row_number() OVER (PARTITION BY run ORDER BY ts, poll) AS n FROM a WHERE elapsed > 600 AND event_type <> 'purchase') WHERE n = 1
""")
def poll_timeout(spark, sf_dir):
    """First poll past 600 seconds; an event waits floor(value) seconds and purchase is terminal."""
    polls = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("poll"), "ts", F.floor("value").cast("double").alias("wait"), (F.col("event_type") == "purchase").alias("terminal"))
    return runs.first_timeout(polls, "run", ["ts", "poll"], F.col("wait"), F.col("terminal"), 600.0).select("run", "poll")


# -- parents and lineage: conversations, where the parent of a turn is the turn before -----------


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    return c.select("conv_id", "turn", name(F.col("turn")).alias("id"), name(F.col("turn") - 1).alias("parent_id"), F.col("role").alias("snap"))


@query("SELECT c.conv_id, c.turn, NOT (p.conv_id IS NOT NULL AND lower(p.role) = lower(c.role) AND p.role <> '') AS fresh FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def snapshot_freshness(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return runs.freshness(t, t, "parent_id", "id", "snap").select("conv_id", "turn", "fresh")


@query("SELECT c.conv_id, c.turn, CASE WHEN p.conv_id IS NULL THEN TRUE WHEN p.role = 'system' THEN FALSE ELSE lower(p.role) <> lower(c.role) END AS fresh FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def freshness_strict(spark, sf_dir):
    """As a rebootstrap judges it; a parent with role system stands for one answered with an error."""
    t = _turns(spark, sf_dir)
    return runs.freshness(t, t.withColumn("payload_error", F.col("snap") == "system"), "parent_id", "id", "snap", "rebootstrap").select("conv_id", "turn", "fresh")


@query("""
WITH RECURSIVE w(conv_id, turn, root, depth) AS (
  SELECT c.conv_id, c.turn, c.turn, CAST(0 AS BIGINT) FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE p.conv_id IS NULL
  UNION ALL SELECT c.conv_id, c.turn, w.root, w.depth + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)
SELECT conv_id || '-' || turn AS node, conv_id || '-' || root AS root, depth FROM w
""")
def lineage_depth(spark, sf_dir):
    return runs.lineage(spark, _turns(spark, sf_dir), "id", "parent_id")


# -- JSON ---------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS VARCHAR) AS k_text, TRUE AS has_k, FALSE AS has_error FROM events")
def typed_json_access(spark, sf_dir):
    """``k`` is a number in all props, so it is one as a number and null as a text."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", J.typed(v, "$.k", "NUMBER").alias("k"), J.typed(v, "$.k", "STRING").alias("k_text"), J.has_key("props", "k").alias("has_k"), J.has_key("props", "error").alias("has_error"))


# Bodies are made from orders by one text that both dialects read, and taken apart by each in its own way.
_K = "CAST(o_orderkey AS STRING)"
_BODY = f"""CASE o_orderkey % 7 WHEN 0 THEN '{{"error":null,"id":' || {_K} || ',"result":{{"a":1}}}}' WHEN 1 THEN '{{"result":{{"structuredContent":{{"branch_id":"b' || {_K} || '"}},"isError":true}}}}'
 WHEN 2 THEN '{{"result":{{"isError":true,"n":' || {_K} || '}}}}' WHEN 3 THEN '{{"result":[' || {_K} || ']}}' WHEN 4 THEN '{{''a'':' || {_K} || '}}' WHEN 5 THEN '{{"a":' || {_K} || '}} x'
 ELSE '{{"id":' || {_K} || ',"result":{{"isError":"true","structuredContent":7}}}}' END"""
_PAYLOAD = """CASE WHEN NOT json_valid(body) THEN NULL WHEN list_contains(json_keys(body), 'error') THEN body
 WHEN json_type(body, '$.result') = 'OBJECT' THEN CAST(CASE WHEN json_type(body, '$.result.structuredContent') = 'OBJECT' THEN json_extract(body, '$.result.structuredContent') ELSE json_extract(body, '$.result') END AS VARCHAR) ELSE body END"""


def _orders(spark, sf_dir, body, *more):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(body).alias("body"), *more)


@query(f"SELECT o_orderkey, {_PAYLOAD} AS payload FROM (SELECT o_orderkey, {_BODY} AS body FROM orders)")
def rpc_normalise(spark, sf_dir):
    return _orders(spark, sf_dir, _BODY).select("o_orderkey", J.json_envelope("body").alias("payload"))


@query(f"""SELECT o_orderkey, list_contains(json_keys(body), 'error') AS has_error, coalesce(json_type(body, '$.error') <> 'NULL', FALSE) AS error_given, coalesce(json_type({_PAYLOAD}, '$.isError') = 'BOOLEAN' AND CAST(json_extract({_PAYLOAD}, '$.isError') AS BOOLEAN), FALSE) AS is_error
FROM (SELECT o_orderkey, replace({_BODY}, '"a":1', '"error":1') AS body FROM orders WHERE o_orderkey % 7 NOT IN (4, 5))""")
def rpc_error_flags(spark, sf_dir):
    """Error keys as present, as given a value, and isError as a JSON boolean of the normalised payload."""
    rows = _orders(spark, sf_dir, f"""replace({_BODY}, '"a":1', '"error":1')""").where("o_orderkey % 7 NOT IN (4, 5)")
    v = F.try_parse_json(J.json_envelope("body"))
    return rows.select("o_orderkey", J.has_key("body", "error").alias("has_error"), J.has_value("body", "error").alias("error_given"), F.coalesce(J.typed(v, "$.isError", "BOOLEAN"), F.lit(False)).alias("is_error"))


_LAUNCH = f"""CASE o_orderkey % 6 WHEN 0 THEN '{{"parallel_explore":{{"branches":[{{"id":"p' || {_K} || '"}}]}},"branch_id":"x"}}' WHEN 1 THEN '{{"branches":[{{"id":5}},{{"branch":{{"id":"q' || {_K} || '"}}}}],"id":"y"}}'
 WHEN 2 THEN '{{"branches":["s"],"branch_id":"b' || {_K} || '"}}' WHEN 3 THEN '{{"branch_id":"","id":"z' || {_K} || '"}}' WHEN 4 THEN '{{"id":' || {_K} || '}}' ELSE '{{"branch":{{"branches":[{{"id":""}},{{"branch_id":"d' || {_K} || '"}}]}}}}' END"""
_ID = lambda p: f"CASE WHEN json_type(body, '{p}') = 'VARCHAR' THEN nullif(json_extract_string(body, '{p}'), '') END"


@query("SELECT o_orderkey, coalesce(" + ", ".join(_ID(p) for p in ("$.parallel_explore.branches[0].id", "$.branches[0].id", "$.branches[1].branch.id", "$.branch.branches[0].id", "$.branch.branches[1].branch_id", "$.branch_id", "$.id")) + f", '') AS branch_id FROM (SELECT o_orderkey, {_LAUNCH} AS body FROM orders)")
def branch_id_extract(spark, sf_dir):
    return _orders(spark, sf_dir, _LAUNCH).select("o_orderkey", J.json_branch_id("body").alias("branch_id"))


_LF = "chr(10)"
_STREAM = f"""CASE event_id % 8 WHEN 0 THEN 'data: ' || props || {_LF} || {_LF} WHEN 1 THEN ': ping' || {_LF} || {_LF} || 'data: {{"a":' || {_LF} || 'data: ' || props || '}}' || {_LF} || {_LF}
 WHEN 2 THEN 'data: {{"a":' || props || {_LF} || {_LF} || 'data: }}' || {_LF} || {_LF} WHEN 3 THEN 'event: m' || {_LF} || 'data: hello ' || props || ' bye' || {_LF} || {_LF} WHEN 4 THEN 'DATA : ' || props || {_LF}
 WHEN 5 THEN props || {_LF} WHEN 6 THEN 'data: ' || CAST(event_id AS STRING) || {_LF} || {_LF} ELSE 'data: [DONE]' || {_LF} || {_LF} END"""


@query(f"""SELECT event_id, CASE event_id % 8 WHEN 1 THEN '{{"a":' || chr(10) || props || '}}' WHEN 2 THEN '{{"a":' || props || chr(10) || '}}' WHEN 6 THEN CAST(event_id AS VARCHAR) WHEN 7 THEN NULL ELSE props END AS json,
 CASE WHEN event_id % 8 = 7 THEN 'no JSON data event in SSE response' END AS error, CAST(octet_length(encode({_STREAM})) AS BIGINT) AS n_bytes FROM events""")
def sse_decode(spark, sf_dir):
    """Event streams that carry the props of events: whole, over several lines and events, amid text, without fields."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_STREAM).alias("body")).withColumn("s", J.sse_first_json("body"))
    return rows.select("event_id", "s.json", "s.error", F.octet_length("body").cast("long").alias("n_bytes"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || CAST(event_id AS VARCHAR) || ']' END AS json FROM events")
def json_first_value(spark, sf_dir):
    body = "CASE event_id % 4 WHEN 0 THEN 'x ' || props || ' y }' WHEN 1 THEN '[' || CAST(event_id AS STRING) || '] {}' WHEN 2 THEN event_type ELSE '{' || event_type || '}' END"
    return table(spark, sf_dir, "events").select("event_id", J.json_first_value(F.expr(body)).alias("json"))


_ERROR = """CASE o_orderkey % 6 WHEN 0 THEN '"  "' WHEN 1 THEN '" ' || o_orderpriority || ' "' WHEN 2 THEN '{"message":" ' || o_orderpriority || ' "}' WHEN 3 THEN '{"code":' || CAST(o_custkey AS STRING) || '}' WHEN 4 THEN CAST(o_custkey AS STRING) ELSE 'null' END"""


@query(f"""SELECT o_orderkey, CASE json_type(e) WHEN 'VARCHAR' THEN coalesce(nullif(trim(json_extract_string(e, '$')), ''), 'unknown error') WHEN 'OBJECT' THEN coalesce(trim(json_extract_string(e, '$.message')), e) WHEN 'NULL' THEN 'unknown error' ELSE e END AS message FROM (SELECT o_orderkey, {_ERROR} AS e FROM orders)""")
def error_text(spark, sf_dir):
    return _orders(spark, sf_dir, _ERROR).select("o_orderkey", J.json_error_message("body").alias("message"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN json_object('error', json_object('details', json_object('status', 'failed'), 'instruction', 'FINISHED_WITH_ERROR', 'message', o_orderpriority), 'status', 'error')
 WHEN 1 THEN json_object('error', json_object('message', 'tool execution error'), 'status', 'error') WHEN 2 THEN json_object('error', o_orderpriority, 'status', 'error') ELSE json_object('error', 'unknown error', 'status', 'error') END AS VARCHAR) AS payload FROM orders""")
def error_payload(spark, sf_dir):
    """Typed errors with all parts and with none, a plain text, and no error at all."""
    k = F.col("o_orderkey") % 4
    message = F.when(k == 0, F.concat(F.lit(" "), "o_orderpriority")).when(k == 1, " ").when(k == 2, F.col("o_orderpriority"))
    payload = J.json_error_payload(message, F.when(k == 0, "FINISHED_WITH_ERROR"), F.when(k == 0, '{"status":"failed"}').when(k == 1, "{}"), k < 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload"))


@query(f"""SELECT o_orderkey, kind, CASE WHEN kind <> 'http_error' THEN {_PAYLOAD} END AS payload, CASE WHEN kind = 'http_error' THEN 'HTTP 500' WHEN NOT json_valid(body) THEN 'response is not a JSON object' END AS problem
FROM (SELECT o_orderkey, {_BODY} AS body, CASE WHEN o_custkey % 4 = 0 THEN 'http_error' WHEN o_custkey % 4 < 3 AND o_orderkey % 7 < 4 THEN 'sse' ELSE 'json' END AS kind FROM orders)""")
def rpc_answers(spark, sf_dir):
    """Answers by status and content type; streams carry the same bodies as one event."""
    sse = F.expr("o_custkey % 4 < 3 AND o_orderkey % 7 < 4")
    rows = _orders(spark, sf_dir, _BODY, F.when(F.col("o_custkey") % 4 == 0, 500).otherwise(200).alias("http_status"), F.when(sse, "Text/Event-Stream; charset=utf-8").otherwise("application/json").alias("content_type"))
    rows = rows.withColumn("body", F.when(F.contains("content_type", F.lit("Stream")), F.concat(F.lit("event: message\ndata: "), "body", F.lit("\n\n"))).otherwise(F.col("body")))
    return records.answers(rows).select("o_orderkey", "kind", "payload", "problem")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS output, event_id % 3 = 0 AS is_text FROM events")
def output_texts(spark, sf_dir):
    """Outputs of branch answers: texts are trimmed, anything else counts as empty."""
    body = F.expr("""'{"output":' || CASE event_id % 3 WHEN 0 THEN '" ' || event_type || ' "' WHEN 1 THEN CAST(event_id AS STRING) ELSE 'null' END || '}'""")
    v = F.try_parse_json(body)
    return table(spark, sf_dir, "events").select("event_id", J.output_text(v).alias("output"), J.typed(v, "$.output", "STRING").isNotNull().alias("is_text"))


# -- predicates, excerpts, texts ----------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'Finished' END"


@query("SELECT o_orderkey, s IN ('failed', 'finished') AS terminal, s = 'finished' AS success, s = 'failed' AS final_failure FROM (SELECT o_orderkey, lower(" + _STATUS + ") AS s FROM orders)")
def status_classify(spark, sf_dir):
    """Order statuses F, O and P stand for failed, running and finished, with stray case and space."""
    s = F.when(F.col("o_orderstatus") == "F", " Failed\t").when(F.col("o_orderstatus") == "O", " running").otherwise("Finished\n")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    return rows.select("o_orderkey", S.is_terminal("s").alias("terminal"), S.is_success("s").alias("success"), S.is_terminal_failure(F.lit("FINISHED_WITH_ERROR"), "s").alias("final_failure"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 400 THEN substr(hex(encode(text)), 1, 800) || '2E2E2E' ELSE hex(encode(text)) END AS excerpt FROM documents")
def failure_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(S.byte_excerpt("text")).alias("excerpt"))


@query("SELECT d.doc_id, coalesce(nullif(trim(c.text), ''), nullif(trim(d.lang), ''), d.source) AS response FROM documents d LEFT JOIN (SELECT conv_id, min(text) AS text FROM conversations WHERE turn = 0 GROUP BY conv_id) c ON c.conv_id = d.doc_id")
def response_precedence(spark, sf_dir):
    """First turns stand for branch output, the language for status output, the source for the summary."""
    c = table(spark, sf_dir, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("out"))
    d = table(spark, sf_dir, "documents").join(c, F.col("doc_id") == F.col("conv_id"), "left")
    return tools.response_text(d, "out", "lang", "source").select("doc_id", "response")


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN '404: not found' END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def artifact_lookup(spark, sf_dir):
    """Labels stand for recorded artifacts; a document without one is not found."""
    return tools.look_up(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], "quality").select("doc_id", "quality", "error")


@query("""
WITH a AS (SELECT doc_id // 3 AS review, doc_id % 3 + 1 AS attempt, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT review, CASE WHEN min(CASE WHEN NOT missing THEN attempt END) IS NULL THEN 'exhausted' ELSE 'done' END AS result, CAST(coalesce(min(CASE WHEN NOT missing THEN attempt END), count(*)) AS BIGINT) AS attempts FROM a GROUP BY review
""")
def review_retry(spark, sf_dir):
    """Three documents in a row are the attempts of a review; one without a label has no artifact."""
    a = tools.look_up(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").withColumn("content", F.lit("ok")), ["doc_id"], "content")
    a = a.select(F.expr("doc_id div 3").alias("review"), (F.col("doc_id") % 3 + 1).alias("attempt"), "error", "content")
    return runs.review_result(a).select("review", "result", "attempts")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
b AS (SELECT l_orderkey AS call, l_linenumber - 1 AS attempt, q > 25 AS ok FROM a WHERE l_linenumber <= 3),
p AS (SELECT call, min(CASE WHEN ok THEN attempt END) AS at FROM b GROUP BY call)
SELECT b.call, CAST(count(*) AS BIGINT) AS attempts, CAST(any_value(p.at) AS INTEGER) AS succeeded_at, CAST(sum(CASE WHEN NOT ok AND attempt < 2 THEN CAST(1 AS BIGINT) << attempt ELSE 0 END) AS BIGINT) AS waited_s
FROM b JOIN p ON b.call = p.call WHERE p.at IS NULL OR b.attempt <= p.at GROUP BY b.call
""")
def rpc_retry(spark, sf_dir):
    """An order is a call, its first three lines are attempts, and quantities over 25 succeed."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    a = a.select(F.col("l_orderkey").alias("call"), (F.col("l_linenumber") - 1).alias("attempt"), (F.col("q") > 25).alias("ok"), F.lit(False).alias("body_error"))
    return tools.call_attempts(a).select("call", "attempts", "succeeded_at", "waited_s")


@query("""
WITH a AS (SELECT user_id, event_id, event_type, sum(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id) AS elapsed FROM events),
o AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'get_error' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'failed' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'success' WHEN elapsed > 3000 AND NOT (event_type = 'error' AND event_id % 5 = 0) THEN 'timeout' END AS outcome FROM a)
SELECT user_id AS branch_id, arg_min(outcome, event_id) AS outcome, min(event_id) AS decided_at FROM o WHERE outcome IS NOT NULL GROUP BY user_id
""")
def poll_outcome(spark, sf_dir):
    """Events of a user are polls of a branch: errors may be failed lookups or statuses, purchases may be finished."""
    e, n = F.col("event_type"), F.col("event_id")
    p = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("branch_id"),
        n.alias("poll_no"),
        F.when((e == "error") & (n % 7 == 0), "reset").alias("get_error"),
        F.lit(False).alias("has_error"),
        F.lit("b").alias("id"),
        F.when((e == "error") & (n % 5 == 0), "FAILED").when((e == "purchase") & (n % 3 == 0), " Finished").otherwise("running").alias("status"),
        F.lit(True).alias("fresh"),
        F.sum(F.floor("value")).over(Window.partitionBy("user_id").orderBy("event_id")).alias("elapsed"),
    )
    return runs.poll_outcome(p, timeout=3000.0).select("branch_id", "outcome", "decided_at")


@query("""
SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_mktsegment || ' ' END), ''), c_name) AS project,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' || c_mktsegment || ' ' END AS task,
  CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'http://localhost:8000/mcp/sse' END AS url,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN c_mktsegment ELSE '' END AS legacy, 'codex' AS agent FROM customer
""")
def config_overlay(spark, sf_dir):
    """Customer names stand for saved state, market segments for configuration, blank for every third."""
    k = F.col("c_custkey")
    config = F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    url, legacy = F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.when(k % 5 == 0, F.col("c_mktsegment")).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", S.overlay("c_name", config).alias("project"), S.overlay("c_name", config, trimmed=False).alias("task"), S.endpoint(url, legacy).alias("url"), S.legacy_endpoint(url, legacy).alias("legacy"), S.first_non_blank(F.lit(" "), F.lit(S.DEFAULT_AGENT)).alias("agent"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '/w/' || n_name || '/code_review.log' END AS path FROM nation")
def review_paths(spark, sf_dir):
    w = F.when(F.col("n_nationkey") % 4 == 0, " \t").otherwise(F.concat(F.lit(" /w/"), "n_name", F.lit("//")))
    return table(spark, sf_dir, "nation").select("n_nationkey", S.review_path(w).alias("path"))


@query("SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE event_type WHEN 'error' THEN 'episode_failed' WHEN 'purchase' THEN 'episode_completed' END AS template_id, CASE event_type WHEN 'error' THEN CAST(user_id AS VARCHAR) WHEN 'purchase' THEN CAST(event_id AS VARCHAR) END AS arg FROM events WHERE event_type IN ('error', 'purchase', 'view')")
def log_parse(spark, sf_dir):
    """Events rendered as log lines and read again; clicks and signups are debug lines, which are below the level."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind.isin("purchase", "view"), "INFO").otherwise("DEBUG")
    message = F.when(kind == "error", F.format_string("Episode branch %d failed (attempt 1/3).", "user_id")).when(kind == "purchase", F.format_string("Episode %d completed. anchor_branch_id=%d", "event_id", "user_id")).otherwise(F.lit("something else"))
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS"), level, message).alias("value"))
    return texts.parse_logs(lines, least="INFO").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "template_id", F.try_element_at("args", F.lit(1)).alias("arg"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'PASS' WHEN doc_id % 3 = 2 THEN 'FAIL' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id END AS pr_url, CASE WHEN doc_id % 3 = 0 THEN lang || chr(10) || text END AS report, doc_id % 3 = 1 AS clean FROM documents""")
def protocol_markers(spark, sf_dir):
    """Texts of documents as reports: whole, a bare sentinel, and a report that never ends."""
    k, n = F.col("doc_id") % 3, F.lit("\n")
    report = F.concat(F.lit("x\nVERDICT=PASS \nPR_URL="), "source", F.lit("/"), "doc_id", F.lit("\nBEGIN_REPORT\n"), "lang", n, "text", F.lit("\nEND_REPORT\n"))
    body = F.when(k == 0, report).when(k == 1, " NO_P0_P1\n").otherwise(F.concat(F.lit("VERDICT=FAIL\nBEGIN_REPORT\n"), "lang"))
    return table(spark, sf_dir, "documents").withColumn("body", body).select("doc_id", texts.marker("body", "VERDICT").alias("verdict"), texts.marker("body", "PR_URL").alias("pr_url"), texts.section("body", "REPORT").alias("report"), texts.is_sentinel("body", "NO_P0_P1").alias("clean"))


_CALL = """CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN '{' WHEN 2 THEN '{"branch_id":"b","full_output":true}' WHEN 3 THEN '{"branch_id":" b ","full_output":"true"}' WHEN 4 THEN '{"branch_id":"  "}'
 WHEN 5 THEN 'null' WHEN 6 THEN '{"branch_id":"b"} x' WHEN 7 THEN '{"branch_id":"a","branch_id":"c"}' WHEN 8 THEN '{"branch_id":"b","path":3}' WHEN 9 THEN '{"branch_id":"b","path":"p"}' WHEN 10 THEN '{"agent":"a","prompt":"p","parent_branch_id":"b"}' ELSE '  ' END"""
_TOOL = "CASE o_custkey % 6 WHEN 0 THEN 'execute_agent' WHEN 1 THEN 'check_status' WHEN 2 THEN 'read_artifact' WHEN 3 THEN 'branch_output' WHEN 4 THEN '' ELSE 'zip' END"


@query(f"""
WITH a AS (SELECT o_orderkey, {_TOOL} AS name, {_CALL} AS text FROM orders),
b AS (SELECT *, CASE WHEN text IN ('', 'null') THEN '{{}}' WHEN json_valid(text) THEN replace(text, '"branch_id":"a",', '') END AS args FROM a),
c AS (SELECT *, CASE WHEN json_type(args, '$.branch_id') = 'VARCHAR' THEN json_extract_string(args, '$.branch_id') ELSE '' END AS b, CASE WHEN json_type(args, '$.path') = 'VARCHAR' THEN json_extract_string(args, '$.path') ELSE '' END AS p FROM b)
SELECT o_orderkey, CASE WHEN name = '' THEN 'Missing tool name in call.' WHEN args IS NULL THEN 'Invalid JSON arguments: not JSON' WHEN name = 'zip' THEN 'Unsupported tool: zip'
 WHEN name = 'execute_agent' THEN CASE WHEN json_extract_string(args, '$.agent') IS NULL THEN 'missing required arguments' END WHEN name = 'check_status' THEN CASE WHEN b = '' THEN '`branch_id` is required' END
 WHEN name = 'read_artifact' THEN CASE WHEN b = '' OR p = '' THEN '`branch_id` and `path` are required' END WHEN trim(b) = '' THEN '`branch_id` is required' WHEN coalesce(json_type(args, '$.full_output'), 'BOOLEAN') <> 'BOOLEAN' THEN '`full_output` must be a boolean' END AS problem,
 CASE WHEN name = 'execute_agent' AND json_extract_string(args, '$.agent') IS NOT NULL THEN 'home' END AS project FROM c
""")
def tool_dispatch(spark, sf_dir):
    """Calls by tool and argument text; the project has a default."""
    calls = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOOL).alias("name"), F.expr(_CALL).alias("arguments"))
    return tools.check_calls(calls, default_project=F.lit("home")).select("o_orderkey", "call.problem", "call.project")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3, 4) THEN 'execute_agent' WHEN l_linenumber IN (5, 6) THEN 'read_artifact' WHEN l_linenumber = 7 THEN 'branch_output' END AS tool FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def tool_catalogue(spark, sf_dir):
    """The parameters that tools offer, by number, joined to lines of orders that call them."""
    offered = tools.catalogue(spark).select("tool", F.monotonically_increasing_id().alias("__at")).select("tool", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__at")).alias("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(F.broadcast(offered), "l_linenumber", "left").select("l_orderkey", "l_linenumber", "tool")


_FAULT = "CASE o_orderkey % 3 WHEN 0 THEN 'HTTP 404 ' || o_orderpriority WHEN 1 THEN 'branch Not Found ' || CAST(o_orderkey AS STRING) ELSE o_orderpriority || CAST(o_orderkey AS STRING) END"


@query(f"SELECT o_orderkey, contains(lower({_FAULT}), '404') AS artifact_missing, contains(lower({_FAULT}), '404') OR contains(lower({_FAULT}), 'not found') AS branch_missing FROM orders")
def not_found_rules(spark, sf_dir):
    return _orders(spark, sf_dir, _FAULT).select("o_orderkey", S.missing_artifact("body").alias("artifact_missing"), S.missing_branch("body").alias("branch_missing"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) ELSE text END AS chars, CAST(least(octet_length(encode(text)), 500) AS BIGINT) AS most_bytes FROM documents")
def previews(spark, sf_dir):
    """Capped texts: by characters for messages, by bytes for streams (a cut character counts as replaced)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.preview_chars("text", 200).alias("chars"), F.octet_length(F.substring(F.encode("text", "UTF-8"), 1, 500)).cast("long").alias("most_bytes"))


@query("""SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 = 0 THEN 21600 ELSE c_custkey % 100 END AS DOUBLE) AS timeout_s, CAST(CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE c_custkey % 7 END AS DOUBLE) AS poll_s,
 CAST(CASE WHEN c_custkey % 9 >= CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE c_custkey % 7 END THEN c_custkey % 9 ELSE 30 END AS DOUBLE) AS max_poll_s, CASE WHEN c_custkey % 4 = 0 THEN 'http://localhost:8000/mcp/sse' ELSE 'http://' || c_name END AS url FROM customer WHERE c_custkey % 100 > 0""")
def call_settings(spark, sf_dir):
    """Poll settings given by arguments over the defaults, and endpoints of clients."""
    k = F.col("c_custkey")
    got = S.poll_settings(F.when(k % 5 > 0, k % 100 + 0.5), (k % 7).cast("double"), (k % 9).cast("double"))
    url = S.client_settings(F.when(k % 4 == 0, "/").otherwise(F.concat(F.lit("http://"), "c_name", F.lit("//"))))
    return table(spark, sf_dir, "customer").where("c_custkey % 100 > 0").select("c_custkey", got.alias("p"), url.alias("u")).select("c_custkey", "p.*", "u.url")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS episode, 'Set up.' || chr(10) || 'Report.' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'skills=' || c_mktsegment ELSE '' END || chr(10) || 'account=' || c_name AS bootstrap FROM customer")
def prompts(spark, sf_dir):
    """Texts put together from settings; a blank one is left out."""
    k, name = F.col("c_custkey"), F.concat(F.lit(" "), "c_name", F.lit("\n"))
    lines = S.bootstrap_prompt(["Set up.", "Report."], {"skills": F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(" "), "account": name})
    return table(spark, sf_dir, "customer").select("c_custkey", S.episode_prompt(F.when(k % 3 == 0, "\t").otherwise(name)).alias("episode"), lines.alias("bootstrap"))


@query("SELECT o_custkey AS pr, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS kept FROM orders GROUP BY o_custkey")
def idempotent_comments(spark, sf_dir):
    """One comment per key, the first; a customer stands for the key, orders for attempts to comment."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pr"), F.col("o_orderkey").alias("kept"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return texts.first_by_key(o, ["pr"], "at").select("pr", "kept")


@query("SELECT o_custkey AS project, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS plan FROM orders GROUP BY o_custkey")
def plan_upsert(spark, sf_dir):
    """One plan per project, the latest written."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_totalprice").alias("plan"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return texts.latest_by_key(o, "project", "at").select("project", "plan")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND source = 'src3'")
def post_search(spark, sf_dir):
    return texts.search_posts(table(spark, sf_dir, "documents"), "The", project="src3", project_col="source").select("doc_id")


@query("SELECT event_id, 'p' || event_id AS post_id, CASE WHEN event_id % 2 = 0 THEN 'c' || user_id END AS comment_id FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 <> 0")
def unread_notifications(spark, sf_dir):
    """Clicks stand for mentions, views for replies, and every third is read."""
    payload = F.expr("""'{"post_id":"p' || CAST(event_id AS STRING) || '"' || CASE WHEN event_id % 2 = 0 THEN ',"comment_id":"c' || CAST(user_id AS STRING) || '"' ELSE '' END || '}'""")
    kind = F.when(F.col("event_type") == "click", "mention").when(F.col("event_type") == "view", "reply").otherwise("other")
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("type"), F.when(F.col("event_id") % 3 == 0, True).alias("read"), payload.alias("payload"))
    return texts.unread(rows).select("event_id", "post_id", "comment_id")


@query("SELECT o_orderpriority AS scope, CAST(count(*) AS BIGINT) AS findings, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS severe FROM orders GROUP BY o_orderpriority")
def triage_counts(spark, sf_dir):
    """Findings and severe ones by scope; an order stands for a finding, its priority for the scope."""
    return texts.triage(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "scope"), "scope", F.col("o_orderstatus") == "F")


@query(_A + "SELECT run, branch, coalesce(last_value(CASE WHEN NOT failed AND branch % 3 = 0 THEN branch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY ts, branch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS anchor FROM a")
def fix_anchor(spark, sf_dir):
    """Only successful fixes move the anchor; every third attempt is a fix."""
    return runs.with_anchor(attempts(spark, sf_dir), "run", "branch", ~F.col("failed") & (F.col("branch") % 3 == 0), _ORDER, F.lit(-1).cast("long")).select("run", "branch", "anchor")


# -- the state machine: a user is a run, its events in order of time are its steps ---------------

_SEQ = "s AS (SELECT CAST(user_id AS VARCHAR) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type FROM events)"


def _recorded(spark, sf_dir):
    """Errors are failed branches, other events succeed."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    none = F.lit(None).cast("string")
    return e.select(
        F.col("user_id").cast("string").alias("run"), n.alias("seq"), F.lit(False).alias("stop"), none.alias("launch_error"), F.lit(False).alias("is_error"), F.concat(F.lit("b"), "event_id").alias("branch"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("poll"), none.alias("output_error"), F.lit("out").alias("output"), F.lit(False).alias("stop_after"), "event_id", "event_type",
    )


_MACHINE = f"""
WITH {_SEQ}, f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) - coalesce(max(CASE WHEN event_type <> 'error' THEN seq END) OVER (PARTITION BY run ORDER BY seq), 0) AS streak FROM s),
k AS (SELECT * FROM f WHERE seq <= coalesce((SELECT min(g.seq) FROM f g WHERE g.run = f.run AND g.streak >= 3), seq))
SELECT run, coalesce('b' || arg_max(event_id, seq) FILTER (WHERE event_type <> 'error'), 'start') AS anchor, CAST(count(*) AS BIGINT) AS launches, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS episodes, CAST(arg_max(streak, seq) AS BIGINT) AS streak, max(streak) >= 3 AS ended FROM k GROUP BY run"""


@query(_MACHINE)
def state_machine_stream(spark, sf_dir):
    """The state machine as a stream over recorded steps, which arrive in any order; the last state of each run."""
    base = scratch.folder(spark, "state-machine")
    _recorded(spark, sf_dir).drop("event_id", "event_type").repartition(4, F.xxhash64("run", "seq")).write.parquet(f"{base}/steps")
    arriving = spark.readStream.schema(episodes.STEP).parquet(f"{base}/steps")
    controller.run_to_end(controller.track(arriving, "start"), f"{base}/out", f"{base}/checkpoint")
    last = texts.latest_by_key(spark.read.schema(controller.OUTPUT).parquet(f"{base}/out"), "run", "seq")
    return last.select("run", "anchor", "launches", "episodes", "streak", "ended")


@query(f"""
WITH {_SEQ},
o AS (SELECT *, CASE WHEN event_id % 41 = 0 THEN 'stop' WHEN event_id % 37 = 0 AND NOT (seq = 1 AND user_active) THEN 'launch_error' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 31 = 0 THEN 'poll_error' WHEN event_id % 29 = 0 THEN 'blank_output' ELSE 'success' END AS outcome
  FROM (SELECT *, CAST(run AS BIGINT) % 5 = 0 AS user_active, CAST(run AS BIGINT) % 4 = 0 AS boot, CAST(run AS BIGINT) % 10 AS most FROM s)),
g AS (SELECT *, count(*) FILTER (WHERE outcome = 'success') OVER w AS good, seq - coalesce(max(CASE WHEN outcome = 'success' THEN seq END) OVER w, 0) - CASE WHEN outcome = 'failed' THEN 0 ELSE 1 END AS streak FROM o WINDOW w AS (PARTITION BY run ORDER BY seq)),
x AS (SELECT *, outcome NOT IN ('success', 'failed') OR outcome = 'failed' AND streak >= 3 AS ends, most > 0 AND good - CAST(outcome = 'success' AS INTEGER) - CAST(boot AS INTEGER) >= most AS past FROM g),
k AS (SELECT * FROM x WHERE NOT past AND seq <= coalesce((SELECT min(y.seq) FROM x y WHERE y.run = x.run AND y.ends), seq)),
r AS (SELECT run, arg_max(CASE WHEN user_active AND seq = 1 THEN 'kept' ELSE 'b' || event_id END, seq) FILTER (WHERE outcome = 'success') AS anchor, arg_max(outcome, seq) AS last, count(*) FILTER (WHERE outcome = 'success') AS good, any_value(boot) AS boot,
  arg_max(CASE WHEN user_active AND seq = 1 THEN 'kept' ELSE 'b' || event_id END, seq) AS branch, count(*) FILTER (WHERE outcome NOT IN ('stop', 'launch_error') AND NOT (user_active AND seq = 1)) AS launches, count(*) FILTER (WHERE outcome = 'failed') AS failures, arg_max(streak, seq) AS streak, bool_or(ends) AS ended, min(seq) FILTER (WHERE seq = 1 AND user_active) AS resumed, max(seq) AS n FROM k GROUP BY run)
SELECT run, coalesce(anchor, 'start') AS anchor, CASE WHEN last IN ('poll_error', 'blank_output') THEN branch WHEN last = 'stop' AND n = 1 AND resumed = 1 THEN 'kept' ELSE '' END AS active, NOT boot OR good > 0 AS initialized, CAST(greatest(good - CAST(boot AS INTEGER), 0) AS BIGINT) AS episodes, CAST(launches AS BIGINT) AS launches, CAST(1200 * failures AS BIGINT) AS slept_s, CASE WHEN ended AND last <> 'stop' THEN last END AS error FROM r
""")
def episode_states(spark, sf_dir):
    """All ways a step may end, in batch: every fifth run resumes a branch, every fourth needs a bootstrap, and runs have at most run % 10 episodes."""
    n, k = F.col("event_id"), F.col("run").cast("long")
    rows = _recorded(spark, sf_dir).withColumn("stop", n % 41 == 0).withColumn("launch_error", F.when(n % 37 == 0, "reset")).withColumn("poll", F.when((n % 31 == 0) & (F.col("poll") == "success"), "timeout").otherwise(F.col("poll"))).withColumn("output", F.when(n % 29 == 0, " \n").otherwise("out"))
    begun = rows.select("run").distinct().select("run", F.lit(" start").alias("anchor"), F.lit("").alias("parent"), F.when(k % 5 == 0, "kept").alias("active"), (k % 4 != 0).alias("initialized"), F.lit(False).alias("rebootstrap"), F.lit("p").alias("project"), (k % 10).alias("max_episodes"))
    begun = episodes.start(begun)
    return episodes.final_states(episodes.steps(rows, begun), begun).select("run", "anchor", "active", "initialized", "episodes", "launches", "slept_s", "error")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'cannot rebootstrap with an active episode branch still running (active_episode_branch_id=' || c_name || ') (status=running)'
 WHEN c_custkey % 5 = 0 THEN 'project_name is required' WHEN c_custkey % 7 = 0 THEN 'parent_branch_id is required for first run' END AS error, c_custkey % 2 = 0 OR c_custkey % 11 = 0 AS bootstrap,
 CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0 AND c_custkey % 7 > 0 THEN '' ELSE c_name END AS active FROM customer""")
def start_checks(spark, sf_dir):
    """Customers as runs that begin: every second rebootstraps with a branch, of which every third still runs."""
    k = F.col("c_custkey")
    runs_ = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("run"), F.lit("").alias("anchor"), F.when(k % 7 > 0, "parent").alias("parent"), F.col("c_name").alias("active"), (k % 11 != 0).alias("initialized"), (k % 2 == 0).alias("rebootstrap"), F.when(k % 5 > 0, "p").otherwise(" ").alias("project"), F.lit(0).cast("long").alias("max_episodes"))
    none = F.lit(None).cast("string")
    found = runs_.select("run", F.col("active").alias("branch"), none.alias("error"), F.when(k % 3 == 1, "404: gone").alias("payload_error"), F.when(k % 3 == 0, " Running").otherwise("failed").alias("status"), F.lit("s").alias("latest_snap_id"), none.alias("parent_id"))
    parents = spark.createDataFrame([], "id string, error boolean, payload_error boolean, latest_snap_id string")
    return episodes.start(runs_, episodes.still_running(found, parents)).select("c_custkey", "error", "bootstrap", "active")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS response,
 CASE o_orderkey % 5 WHEN 0 THEN 'ParallelExplore failed: reset' WHEN 1 THEN 'ParallelExplore returned error: busy' WHEN 2 THEN 'Missing branch id in parallel_explore response: {"id":7}' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'branch_output returned no textual output' END END AS error,
 CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN 'FINISHED_WITH_ERROR' END AS instruction, o_orderkey % 5 > 2 AS recorded FROM orders""")
def run_once(spark, sf_dir):
    """Orders as launches whose answers are recorded; the priority is the text of the output or of the summary."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders")
    answer = F.when(k % 5 == 1, '{"isError":true,"error":"busy"}').when(k % 5 == 2, '{"id":7}').otherwise(F.concat(F.lit('{"branch_id":"b'), k, F.lit('"}')))
    launches = o.select(k.alias("n"), F.when(k % 5 > 0, answer).alias("response"), F.when(k % 5 == 0, "reset").alias("error"))
    text = F.when(k % 7 > 0, F.col("o_orderpriority")).otherwise(" ")
    branch = F.concat(F.lit("b"), k)
    polls = o.select(branch.alias("branch_id"), F.concat(F.lit('{"status":"finished","manifest":{"summary":"'), text, F.lit('"}}')).alias("answer"), none.alias("error"), none.alias("instruction"))
    outputs = o.select(branch.alias("branch_id"), F.when(k % 2 == 0, text).alias("output"), none.alias("error"))
    return tools.run_once(launches, polls, outputs).select(F.col("n").alias("o_orderkey"), "result.response", "error", "instruction", "recorded")


# -- saved states and all forms of log messages --------------------------------------------------


@query("SELECT c_custkey, nullif(c_name, '') AS project_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS agent, CASE WHEN c_custkey % 3 = 0 THEN TRUE END AS initialized FROM customer")
def saved_states(spark, sf_dir):
    """States written twice and read back: the second version counts, without empty texts and false."""
    base = scratch.folder(spark, "states")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("project_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("agent"), (F.col("c_custkey") % 3 == 0).alias("initialized"))
    records.save_version(c.withColumn("agent", F.lit("old")), base + "/v", 1, key="key")
    records.save_version(c, base + "/v", 2, key="key")
    return records.current_state(spark, base + "/v", key="key").select(F.col("key").cast("long").alias("c_custkey"), "project_name", "agent", "initialized")


#: A message of each form, with the order's key as first argument where it has one, in the order of ``texts.TEMPLATES``.
_MESSAGES = [
    "Clearing stopped active_episode_branch_id=%s before rebootstrap (status=x y).", "Bootstrap required (anchor=%s). Running bootstrap episode.", "Reached max_episodes=%s. Exiting.", "Stop requested. Exiting after current episode.", "Episode branch %s failed (attempt 2/3).",
    "Bootstrap completed. anchor_branch_id=%s", "Episode %s completed. anchor_branch_id=b", "MCP POST %s attempt 1 to http://h/", "MCP HTTP error %s for get (CT=text/html): oops", "MCP SSE preview: %s", "Failed to parse SSE JSON for %s. Preview: x",
    "MCP SSE payload not JSON (status %s, CT=a/b). Preview: (x)", "Failed reading MCP response body for %s: eof (bytes=3)", "MCP response not JSON (status %s, CT=a). First 1000 bytes: <x>", "MCP call %s failed (attempt 1/3): a: b. Retrying in 1s...", "Executing agent %s on project a b from parent p",
    "Waiting for branch %s to complete.", "review_code attempt %s/3 did not produce /w/l (branch=b)", "Checking status for branch %s (timeout=60s)", "Error getting parent branch %s: boom", "Branch %s response (attempt 1): {}", "Branch %s still active (status=running). Sleeping 3.0s.",
    "Reading artifact %s from branch b", "Retrieving branch_output for %s (full_output=true)",
]


@query("SELECT o_orderkey, ([" + ", ".join(f"'{k}'" for k, _ in texts.TEMPLATES) + "])[CAST(o_orderkey % 24 + 1 AS INTEGER)] AS template_id, CASE WHEN o_orderkey % 24 <> 3 THEN CAST(o_orderkey AS VARCHAR) END AS arg, CAST(([" + ", ".join(str(p.replace("\\(", "").replace("(?s)", "").count("(")) for _, p in texts.TEMPLATES) + "])[CAST(o_orderkey % 24 + 1 AS INTEGER)] AS INTEGER) AS n_args FROM orders")
def log_forms(spark, sf_dir):
    """All 24 forms of messages, filled from orders."""
    form = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("o_orderkey") % 24 + 1).cast("int"))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("2026/01/02 03:04:05.678901 INFO "), F.replace(form, F.lit("%s"), F.col("o_orderkey").cast("string"))).alias("value"))
    return texts.parse_logs(lines).select("o_orderkey", "template_id", F.try_element_at("args", F.lit(1)).alias("arg"), F.size("args").alias("n_args"))
