"""Scalar expressions over recorded run data: trimming, statuses, overlays, excerpts, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trimming removes, as a Java character class.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Statuses that end a branch.
TERMINAL = ("succeed", "ready_for_manifest", "finished", "failed", "manifesting")
# Default endpoint and agent, review file, controller and handler polling (timeout, first wait, longest wait),
# factor of waits, calls, pause after a failure, failures in a row.
DEFAULT_URL = "http://localhost:8000/mcp/sse"
DEFAULT_AGENT = "codex"
REVIEW_LOG = "code_review.log"
CONTROLLER_POLL = (86400, 60, 300)
HANDLER_POLL = (21600, 3, 30)
BACKOFF = 1.5
RPC_TIMEOUT_S, RPC_ATTEMPTS = 30, 3
FAILURE_PAUSE_S = 1200
MAX_FAILURES = 3


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Without Unicode white space at both ends (``trim`` only takes blanks)."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def non_blank(c: Column | str) -> Column:
    """Trimmed, null where nothing is left."""
    return F.nullif(trim_all(c), F.lit(""))


def first_non_blank(*cs: Column | str) -> Column:
    """First argument with something but white space, trimmed; empty if there is none."""
    return F.coalesce(*[non_blank(c) for c in cs], F.lit(""))


def non_blank_or(c: Column | str, default: Column | str) -> Column:
    """``c`` untrimmed if it is not blank, else the default."""
    return F.when(non_blank(c).isNotNull(), col(c)).otherwise(default if isinstance(default, Column) else F.lit(default))


def status_of(c: Column | str) -> Column:
    return F.lower(trim_all(c))


def is_terminal(c: Column | str) -> Column:
    return F.coalesce(status_of(c).isin(*TERMINAL), F.lit(False))


def is_success(c: Column | str) -> Column:
    return is_terminal(c) & (status_of(c) != "failed")


def is_terminal_failure(instruction: Column | str, status: Column | str) -> Column:
    """A typed error that says it is final and whose status is failed; a time-out has no status and is not one."""
    return F.coalesce((col(instruction) == "FINISHED_WITH_ERROR") & (status_of(status) == "failed"), F.lit(False))


def missing_artifact(message: Column | str) -> Column:
    """Not found, as reads of artifacts tell it."""
    return F.coalesce(F.contains(F.lower(col(message)), F.lit("404")), F.lit(False))


def missing_branch(message: Column | str) -> Column:
    """Not found, as branch lookups tell it."""
    return missing_artifact(message) | F.coalesce(F.contains(F.lower(col(message)), F.lit("not found")), F.lit(False))


def byte_excerpt(c: Column | str, n: int = 400) -> Column:
    """Binary: the first ``n`` bytes and three dots if there are more bytes (a cut may fall inside a character)."""
    data = F.encode(col(c), "UTF-8")
    return F.when(F.octet_length(data) > n, F.concat(F.substring(data, 1, n), F.encode(F.lit("..."), "UTF-8"))).otherwise(data)


def preview(c: Column | str, n: int = 2000) -> Column:
    """The first ``n`` bytes as text; what a cut leaves of a character is replaced."""
    return F.make_valid_utf8(F.substring(F.encode(col(c), "UTF-8"), 1, n).cast("string"))


def preview_chars(c: Column | str, n: int) -> Column:
    """The first ``n`` characters, as log messages cap them."""
    return F.substring(col(c), 1, n)


def review_path(workspace: Column | str, name: str = REVIEW_LOG) -> Column:
    w = trim_all(workspace)
    return F.when(w == "", F.lit("")).otherwise(F.concat(F.regexp_replace(w, "/+$", ""), F.lit("/" + name)))


def backoff_waits(first: Column | str, longest: Column | str, n: int, factor: float = BACKOFF) -> Column:
    """Array of ``n`` waits in seconds as recorded: the first as it is, then floor(min(floor(wait) * factor, longest))."""

    def step(so_far: Column, _: Column) -> Column:
        wait = F.floor(F.least(F.floor(F.element_at(so_far, -1)) * F.lit(factor), col(longest).cast("double"))).cast("double")
        return F.concat(so_far, F.array(wait))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(n - 1, 1))), F.array(col(first).cast("double")), step) if n > 1 else F.array(col(first).cast("double"))


def poll_settings(timeout: Column | str, poll: Column | str, longest: Column | str, default: tuple[float, float, float] = HANDLER_POLL) -> Column:
    """Struct of timeout, first and longest wait in seconds: numbers over 0 replace the defaults, a longest wait only if it is not below the first.

    The timeout is in whole seconds.
    """
    number = lambda c, d: F.coalesce(F.when(col(c) > 0, col(c)), F.lit(float(d)))
    first = number(poll, default[1])
    most = F.coalesce(F.when(col(longest) >= first, col(longest)), F.lit(float(default[2])))
    return F.struct(F.floor(number(timeout, default[0])).cast("double").alias("timeout_s"), first.alias("poll_s"), most.alias("max_poll_s"))


def client_settings(url: Column | str, default: str = DEFAULT_URL) -> Column:
    """Struct of a client's endpoint without slashes at its end (the default if nothing is left), call timeout and attempts."""
    base = F.regexp_replace(F.coalesce(col(url), F.lit("")), "/+$", "")
    return F.struct(F.when(base == "", F.lit(default)).otherwise(base).alias("url"), F.lit(RPC_TIMEOUT_S).alias("timeout_s"), F.lit(RPC_ATTEMPTS).alias("attempts"))


def episode_prompt(task: Column | str) -> Column:
    """The trimmed task; null without one, which is an error."""
    return non_blank(task)


def bootstrap_prompt(lines: list[str], conditional: dict[str, Column | str]) -> Column:
    """Fixed lines, then a line ``name=value`` for each setting that is not blank, joined by newlines."""
    given = [F.when(non_blank(c).isNotNull(), F.concat(F.lit(f"{name}="), non_blank(c))) for name, c in conditional.items()]
    return F.concat_ws("\n", *map(F.lit, lines), *given)


def retry_wait(attempt: Column | str) -> Column:
    """Seconds before the next call attempt: a power of two."""
    return F.expr("1L") * F.pow(F.lit(2), col(attempt)).cast("long")


def overlay(state: Column | str, config: Column | str, trimmed: bool = True) -> Column:
    """Configuration over saved state where it is not blank; trimmed but for the task text."""
    return F.coalesce(non_blank(config) if trimmed else F.when(non_blank(config).isNotNull(), col(config)), col(state))


def endpoint(url: Column | str, legacy: Column | str, default: str = DEFAULT_URL) -> Column:
    """The URL; the legacy one if it is blank; the default if both are."""
    return F.coalesce(non_blank(url), non_blank(legacy), F.lit(default))


def legacy_endpoint(url: Column | str, legacy: Column | str) -> Column:
    """What is kept of the legacy URL: nothing once it has been used."""
    return F.when(non_blank(url).isNull(), F.lit("")).otherwise(F.coalesce(col(legacy), F.lit("")))
