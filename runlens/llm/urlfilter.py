"""URL filters (8): a blocked Bloom filter of listed URLs in front of an exact hash join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import deal, for_each_piece, hot_join, hot_keys
from .common import materialize, unused

#: A list of up to this many rules and bytes is one value, sent to every task; a longer one stays a table.
SMALL_RULES, SMALL_BYTES = 4096, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as canonical keys: after the first ``://`` up to ``/?#``, then up to ``?#``; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _probe(key: Column, blocks: int, k: int) -> tuple[Column, Column]:
    """Block of a key, and the word of ``k`` bits that it sets there (a block is one 64-bit word)."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int"))
    mask = bit(0)
    for i in range(1, k):
        mask = mask.bitwiseOR(bit(i))
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int"), mask


def _lower(c: Column | str) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", bits_per_rule: int = 16, k: int = 5, small: int = SMALL_RULES) -> DataFrame:
    """Every row of ``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the URL's path
    starts with the rule's path; the longest ``host + path`` wins, ties going to the smaller
    rule and verdict. A URL's candidate keys are its host's suffixes at dots, as long as rules
    have hosts, with its path's beginnings of the lengths that rules' paths have. Keys are
    probed in the Bloom filter; only possible hits reach the exact hash join, which removes
    false positives. Null and malformed URLs have empty host and path and match nothing; null
    hosts and paths of rules are empty, and rules without a host match nothing. The frame's
    columns stay; the four new ones replace columns of those names. Repeated rows stay
    repeated. An empty list gives every row the default.

    A list of up to ``small`` rules (and 1 MB) is one value: each block has its filter word and
    its rules, so that rows are judged where they are. A longer list is a table: distinct
    (host, path) are judged by joins, and rows of hot ones are dealt to pieces before they join.
    """
    rules = rules.select(_lower(F.coalesce("host", F.lit(""))).alias("__h"), F.coalesce("path", F.lit("")).alias("__p"), F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("rule"), "verdict").where("__h <> ''")
    rules = rules.groupBy("__h", "__p").agg(F.min(F.struct("rule", "verdict")).alias("__r"))
    rules = materialize(rules.select(F.concat("__h", F.lit("\t"), "__p").alias("__key"), F.size(F.split("__h", r"\.")).alias("__labels"), F.length("__p").alias("__length"), "__r.rule", "__r.verdict"), "rules")
    n, size, labels, lengths = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__key") + F.octet_length("rule")), F.lit(0)), F.collect_set("__labels"), F.collect_set("__length")).first()
    host, path = host_path(F.col(url_col).cast("string"))
    rows = urls.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    if not n:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    blocks = 1 << max(0, math.ceil(math.log2(n * bits_per_rule / 64)))
    block, mask = _probe(F.col("__key"), blocks, k)
    parts = F.split("host", r"\.")
    ends = F.filter(F.array(*map(F.lit, sorted(labels))), lambda i: i <= F.size(parts))
    hosts = F.transform(ends, lambda i: F.concat_ws(".", F.slice(parts, F.size(parts) - i + 1, i)))
    begins = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda i: i <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(begins, lambda i: F.concat(h, F.lit("\t"), F.substring(F.col("path"), F.lit(1), i)))))
    keys = F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))
    if n <= small and size <= SMALL_BYTES:
        cell = F.struct(F.bit_or(mask).alias("word"), F.collect_list(F.struct("__key", "rule", "verdict")).alias("rules"))
        cells = rules.groupBy(block.alias("__block")).agg(cell.alias("__cell")).agg(F.map_from_entries(F.collect_list(F.struct("__block", "__cell"))).alias("__m"))
        table = cells.select(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.try_element_at("__m", i)).alias("__t"))

        listed, best = unused(rows.columns, "__list"), unused(rows.columns, "__best")

        def possible(key: Column) -> Column:
            at, bits = _probe(key, blocks, k)
            cell = F.get(F.col(listed), at)
            return F.coalesce(cell["word"].bitwiseAND(bits) == bits, F.lit(False))

        def exact(key: Column) -> Column:
            cell = F.get(F.col(listed), _probe(key, blocks, k)[0])
            return F.transform(F.filter(cell["rules"], lambda r: r["__key"] == key), lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))

        found = F.array_min(F.flatten(F.transform(F.filter(keys, possible), exact)))
        return rows.withColumn(listed, table.scalar()).withColumn(best, found).drop(listed).withColumn("rule", F.col(best)["rule"]).withColumn("verdict", F.coalesce(F.col(best)["verdict"], F.lit(default))).drop(best)
    words = rules.groupBy(block.alias("__block")).agg(F.bit_or(mask).alias("__word"))
    seen = materialize(rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("__n")), "urls")
    tried = seen.withColumn("__key", F.explode(keys)).withColumn("__block", block).withColumn("__mask", mask)
    tried = materialize(tried.join(words, "__block").where(F.col("__mask").bitwiseAND(F.col("__word")) == F.col("__mask")).select("host", "path", "__key"), "possible")
    exact_hits = hot_join(tried, rules.select("__key", "rule", "verdict"), ["__key"], ["host", "path"])
    best = exact_hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("__b")).select("host", "path", "__b.rule", "__b.verdict")
    hot = hot_keys(seen, ["host", "path"], "__n", seen.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
    whole = rows.select("host", "path", F.struct(*[F.col(c) for c in rows.columns[:-2]]).alias("row"), F.monotonically_increasing_id().alias("at"))
    dealt = deal(whole.where("host <> ''"), hot, ["host", "path"], ["at"])
    judged = dealt.join(for_each_piece(best, hot, ["host", "path"]), ["host", "path", "__s"], "left").drop("__s")
    none = whole.where("host = ''").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
    return judged.unionByName(none).select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
