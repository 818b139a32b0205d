"""Compare rows that share a key: hot keys are cut into blocks, small runs are compared together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a key that are compared in one run; a key with more is cut into blocks, one run for each pair of them.
BLOCK = 1024


#: A key with over 1 / SHARE of all rows is hot. There are fewer than SHARE of them at any size, so their table is broadcast.
SHARE = 1000


def hot_keys(counts: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """``(*on, __p)``: keys of ``counts`` (one row per key, with its number of ``rows``) with over 1 / SHARE of ``total`` rows.

    ``__p`` is in how many pieces to deal the rows of the key, so that a piece has about that share.
    """
    limit = max(total // SHARE, 1)
    return counts.where(F.col(rows) > limit).select(*on, F.ceil(F.col(rows) / limit).cast("int").alias("__p"))


def deal(rows: DataFrame, hot: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """``rows`` with their piece in ``__s``, by a hash of the columns ``by``; 0 where the key is not hot."""
    piece = F.pmod(F.xxhash64(F.lit("piece"), *by), F.coalesce("__p", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), on, "left").withColumn("__s", piece).drop("__p")


def for_each_piece(side: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """``side`` with one row for each piece ``__s`` of its key, to be joined with rows that ``deal`` has dealt."""
    pieces = F.sequence(F.lit(0), F.coalesce("__p", F.lit(1)) - 1)
    return side.join(F.broadcast(hot), on, "left").withColumn("__s", F.explode(pieces)).drop("__p")


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], by: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key, no other columns in common); rows of a hot key are dealt to pieces by a hash of ``by`` first.

    ``rows`` is read three times, so write it before; ``total`` is how many there are, about, counted unless given.
    """
    hot = hot_keys(rows.groupBy(*on).agg(F.count("*").alias("__r")), on, "__r", rows.count() if total is None else total)
    return deal(rows, hot, on, by).join(for_each_piece(side, hot, on), [*on, "__s"], how).drop("__s")


def block_pairs(keys: DataFrame, key: str, spread: str, block: int = BLOCK, total: int = 0) -> DataFrame:
    """``keys`` sorted into runs ``(key, bi, bj)``, with the own block of each row in ``b``.

    A key with at most ``block`` rows is one run. A hotter one has ``ceil(rows / block)``
    blocks, dealt by a hash of ``spread``; every pair of its blocks is a run on its own, so
    each pair of rows meets in some task and no task holds more than about two blocks. The
    table of keys with blocks has at most rows / block entries. Up to SHARE of them are
    broadcast; more are joined, the rows of keys with over 1 / SHARE of all (``total``, or a
    count) being dealt before.
    """
    blocks = keys.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > block).withColumn("__nb", F.ceil(F.col("__n") / block).cast("int"))
    blocks = materialize(blocks, "blocks")
    if blocks.count() <= SHARE:
        dealt = keys.join(F.broadcast(blocks.select(key, "__nb")), key, "left")
    else:
        hot = hot_keys(blocks, [key], "__n", total or keys.count())
        dealt = deal(keys, hot, [key], [spread]).join(for_each_piece(blocks.select(key, "__nb"), hot, [key]), [key, "__s"], "left").drop("__s")
    dealt = dealt.withColumn("__nb", F.coalesce("__nb", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64(F.lit(key), spread), F.col("__nb")).cast("int"))
    dealt = dealt.withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    dealt = dealt.withColumn("bi", F.least("b", "__c")).withColumn("bj", F.greatest("b", "__c")).drop("__nb", "__c")
    return dealt.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs (rows that agree in ``names``, already together), and where each run begins."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for n in names:
            x = t.column(n).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
            held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            yield t, starts(t)


def pairs_of_runs(starts: np.ndarray, n: int, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the same run that ``compare`` accepts, tested ``at_once`` at a time."""
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows of the run after this one
    order = np.flatnonzero(left)
    todo, ends = order, np.cumsum(left[order])
    found_a, found_b = [], []
    begin = 0
    while begin < len(todo):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + at_once, side="right")))
        rows, count = todo[begin:stop], left[todo[begin:stop]]
        a = np.repeat(rows, count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        ok = compare(a, b)
        found_a.append(a[ok])
        found_b.append(b[ok])
        begin = stop
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
