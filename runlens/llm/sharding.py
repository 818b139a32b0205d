"""Sharding (5): hierarchical weighted hash tree, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import deal, hot_keys
from .common import materialize, partitions


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards in order, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def _children(nodes: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in sorted(nodes.items())])


def _draw(key: Column, level: str, children: Column) -> Column:
    """Weighted rendezvous: the child with the largest ``-w / ln(u)``, u drawn from (key, level, child)."""

    def score(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), c["node"]), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return F.struct((-c["weight"] / F.log(u)).alias("score"), (-c["node"]).alias("node"))

    return -F.array_max(F.transform(children, score))["node"]


def shard_column(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of ``key``: a draw among regions, then racks of that region, then shards of that rack.

    A node's weight is the sum below it. If weights change, the only nodes that win keys are
    those on changed paths, so whatever moves ends up inside a subtree whose weight changed; a
    shard opened in a region of its own takes keys only into itself.
    """
    racks: dict[int, dict[int, float]] = {}
    regions: dict[int, dict[int, float]] = {}
    for x in leaves:
        racks.setdefault(x.rack, {})[x.shard] = x.weight
        regions.setdefault(x.region, {}).setdefault(x.rack, 0.0)
        regions[x.region][x.rack] += x.weight
    below = lambda tree: F.create_map(*[c for n, kids in sorted(tree.items()) for c in (F.lit(n), _children(kids))])
    region = _draw(key, "region", _children({r: sum(x.values()) for r, x in regions.items()}))
    rack = _draw(key, "rack", F.element_at(below(regions), region))
    return _draw(key, "shard", F.element_at(below(racks), rack))


def assign(df: DataFrame, key_col: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with ``out``: the shard of each row, decided by the key and the tree alone (null is a key like any other).

    Equal keys share a shard. The frame's own columns stay; ``out`` replaces one of that name.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("\0"))
    return df.withColumn(out, shard_column(key, leaves).cast("int"))


def slots(df: DataFrame, shard_col: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps, no task holding a whole shard.

    Rows are dealt to (shard, bucket) by a hash of ``order``; a bucket numbers its own rows and
    adds the count of the buckets before it. Rows equal in ``order`` that make up over 1 / SHARE
    of all are spread over buckets too; equal rows get different slots. The table of counts has
    shards x buckets rows, a bound that does not grow with the data, and is broadcast. ``df`` is
    read three times, so write it before.
    """
    buckets = partitions(df.sparkSession)
    keyed = df.withColumn("__h", F.xxhash64(*order)).withColumn("__u", F.monotonically_increasing_id())
    hot = hot_keys(keyed.groupBy("__h").agg(F.count("*").alias("__r")), ["__h"], "__r", df.count())
    dealt = deal(keyed, hot, ["__h"], ["__u"]).withColumn("__bucket", F.pmod(F.xxhash64("__h", "__s"), F.lit(buckets)).cast("int")).drop("__h", "__u", "__s")
    own = F.row_number().over(Window.partitionBy(shard_col, "__bucket").orderBy(*order)).cast(T.LongType()) - 1
    numbered = dealt.withColumn("__own", own)
    counts = numbered.groupBy(shard_col, "__bucket").agg((F.max("__own") + 1).alias("__n"))  # reads the exchange that numbers the rows
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(shard_col).orderBy("__bucket")) - F.col("__n")).drop("__n")
    return numbered.join(F.broadcast(before), [shard_col, "__bucket"]).withColumn(out, F.col("__own") + F.col("__before")).drop("__own", "__before", "__bucket")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place documents by id: the whole row with ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard``, ``slot`` and ``grown_shard``.

    Null texts count no bytes; a null id is a key like any other. ``grown_shard`` is the place
    when one more shard is opened in a region of its own. Extra columns are dropped.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    tree = topology(shards)
    grown = [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, shards)]
    placed = materialize(assign(assign(rows, id_col, tree, "shard"), id_col, grown, "grown_shard"), "placed")  # narrow rows: the texts are read once
    return slots(placed, "shard", [id_col, "size", "text_crc32", "grown_shard"])
