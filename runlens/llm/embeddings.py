"""Embedding near-dedup (6): a pivot-permutation index with inverted lists and counts of shared pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import block_pairs, deal, for_each_piece, hot_join, hot_keys, pairs_of_runs, whole_runs
from .common import discard, lean, materialize
from .graph import components, local_components

#: Pivot number of vectors whose dimension has no pivot; they are all compared.
_NO_PIVOT = (1 << 32) - 1


def _usable(v: Column) -> Column:
    """Whether a vector can be compared: not null, empty or zero, and all components finite."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def _hash(v: Column) -> Column:
    return F.xxhash64(v)


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, h, same)`` and classes of equal vectors ``(node, dim, h, same, n, rep, v)``, written.

    Equal vectors share the hash ``h``. Where a hash is that of several vectors, ``same`` holds
    the vector too; it is null everywhere else, so that vectors aren't moved for it.
    """
    kind = vectors.schema[vec_col].dataType
    exact = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    v = F.col(vec_col) if exact else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.when(_usable(v), v).alias("v")).withColumn("h", F.when(F.col("v").isNotNull(), _hash(F.col("v"))))

    def grouped(of: DataFrame) -> DataFrame:
        found = of.where("v is not null").groupBy("h", "same").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.min("v").alias("v"), F.max("v").alias("hi"))
        return materialize(found.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("dim"), "h", "same", "n", "rep", "v", (F.col("v") == F.col("hi")).alias("one")), "vectors")

    rows = rows.withColumn("same", F.lit(None).cast(rows.schema["v"].dataType))
    classes = grouped(rows)
    clash = classes.where("not one").select("h")
    if not clash.isEmpty():
        rows = rows.drop("same").join(materialize(clash.withColumn("clash", F.lit(True)), "clashes"), "h", "left").withColumn("same", F.when(F.col("clash"), F.col("v"))).drop("clash")
        discard(classes)
        classes = grouped(rows)
    return rows.select("id", "h", "same"), classes.drop("one")


def unit(v: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension at length 1, in double precision."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(x: np.ndarray, n: int, apart: float) -> np.ndarray:
    """Up to ``n`` of the unit vectors ``x``, in their order, no two at a cosine of ``apart`` or more."""
    chosen = np.empty((min(n, len(x)), x.shape[1]))
    k = 0
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        free = np.flatnonzero((part @ chosen[:k].T).max(axis=1, initial=-2) < apart)
        for i in free:
            if k == len(chosen):
                return chosen
            if not k or (chosen[max(0, k - 256) : k] @ part[i]).max() < apart:
                chosen[k] = part[i]
                k += 1
    return chosen[:k]


def _pivots(classes: DataFrame, count: int, n_pivots: int | None, threshold: float) -> dict[int, np.ndarray]:
    """Pivots of each dimension: 2 * sqrt(n) unless given, from twice as many and 1024 vectors of the lowest hashes."""
    wanted = n_pivots or max(16, math.ceil(2 * math.sqrt(count)))
    sample = classes.select("dim", "v", F.xxhash64(F.lit("pivot"), "h").alias("o")).orderBy("o", "v").limit(2 * wanted + 1024).toArrow()
    of_dim = sample.column("dim").to_numpy()
    out = {}
    for dim in np.unique(of_dim).tolist():
        own = sample.filter(pa.array(of_dim == dim)).column("v").combine_chunks()
        out[dim] = choose_pivots(unit(own, dim), wanted, 2 * threshold * threshold - 1)
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, n_pivots: int | None = None, prefix: int = 8, shared: int = 4, shift: int = 6, block: int = 512) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links`` (other vectors at cosine >= threshold found by the index), ``component_id``, ``kept``.

    Every vector is described by its ``prefix`` nearest pivots in order of nearness, and stands
    in the inverted list of each. Two vectors are candidates if at least ``shared`` pivots are
    common to them at places not over ``shift`` apart; the list of the smallest of these counts
    the pair, so none counts twice. Lists hold no vectors: only those with a candidate in a list
    are brought there, and cosines in double precision decide. A long list is compared in
    blocks, and gives sums and one link per vector, never all pairs.

    Pivots (2 * sqrt(n) unless given) are fitted on 2 * pivots + 1024 vectors in the driver, a
    bound that grows with the root of the table; no two of them are at twice the angle of
    ``threshold`` or closer, so near copies share theirs. Every vector is indexed. Vectors of
    different dimensions never meet; those of a dimension that is not in the sample are all
    compared. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Equal vectors are one class, so copies cost nothing. Repeated rows count as
    copies. An empty table gives no rows; extra columns are dropped.
    """
    rows, classes = _classes(vectors, id_col, vec_col)
    count = classes.count()
    links, edges = None, None
    if count > 1:
        hits = materialize(_search(classes, count, _pivots(classes, count, n_pivots, threshold), threshold, prefix, shared, shift, block), "hits")
        links = hits.groupBy("node").agg(F.sum("links").alias("links"))
        edges = components(hits.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    of_node = classes.select("node", "h", "same", "n", "rep")
    if links is None:
        of_node = of_node.withColumn("links", F.lit(0)).withColumn("root", F.col("node"))
    else:
        of_node = of_node.join(links, "node", "left").join(edges, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_node = materialize(of_node, "classes")
    of_node = hot_join(of_node, of_node.groupBy("root").agg(F.min("rep").alias("component_id")), ["root"], ["node"])
    of_node = materialize(of_node.select("h", "same", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"), "linked")
    total = of_node.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot_keys(of_node, ["h"], "n", total)
    side = for_each_piece(of_node.drop("n"), hot, ["h"]).select(F.col("h").alias("__h"), F.col("same").alias("__same"), F.col("__s").alias("__t"), "n_links", "component_id")
    out = deal(rows, hot, ["h"], ["id"]).join(side, (F.col("h") == F.col("__h")) & (F.col("__s") == F.col("__t")) & F.col("same").eqNullSafe(F.col("__same")), "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _candidates(starts: np.ndarray, list_of: np.ndarray, own: np.ndarray, allowed, shared: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the same run with enough shared pivots, the smallest of which is the run's own list.

    ``own`` has the pivots of each row in order, -1 after the last. Pairs that meet in a further
    pivot of larger number are counted; only those with enough meetings are compared in full. A
    row with fewer pivots than ``shared`` needs to share all it has.
    """
    n, prefix = own.shape
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    few = (own >= 0).sum(axis=1) < max(shared, 2)  # rows with too few pivots to be told apart by counts: all pairs of their runs
    rows = np.flatnonzero(few)
    p, q = pairs_of_runs(np.flatnonzero(np.diff(run[rows], prepend=-1)), len(rows), lambda a, b: np.ones(len(a), dtype=bool))
    p, q = rows[p], rows[q]
    row, place = np.nonzero((own > list_of[:, None]) & ~few[:, None])
    if len(row):
        key = np.lexsort((own[row, place], run[row]))
        row, place = row[key], place[key]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (run[row][1:] != run[row][:-1]) | (own[row, place][1:] != own[row, place][:-1])
        a, b = pairs_of_runs(np.flatnonzero(new), len(row), lambda x, y: np.abs(place[x] - place[y]) <= shift)
        pair = np.sort(np.minimum(row[a], row[b]) * n + np.maximum(row[a], row[b]))
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        enough = first[np.diff(np.append(first, len(pair))) >= shared - 1]
        p, q = np.concatenate([p, pair[enough] // n]), np.concatenate([q, pair[enough] % n])
    ok = allowed(p, q)
    p, q = p[ok], q[ok]
    count, least = np.zeros(len(p), dtype=np.int64), np.full(len(p), _NO_PIVOT, dtype=np.int64)
    for i in range(prefix):
        for j in range(max(0, i - shift), min(prefix, i + shift + 1)):
            same = (own[p, i] == own[q, j]) & (own[p, i] >= 0)
            count += same
            np.minimum(least, np.where(same, own[p, i], _NO_PIVOT), out=least)
    ok = (least == list_of[p]) & (count >= np.minimum(shared, (own[p] >= 0).sum(axis=1)))
    return p[ok], q[ok]


def _search(classes: DataFrame, total: int, pivots: dict[int, np.ndarray], threshold: float, prefix: int, shared: int, shift: int, block: int) -> DataFrame:
    """Partial sums ``(node, links, root)`` over the inverted lists."""
    shared = min(shared, prefix)

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim in np.unique(whole.column("dim").to_numpy()).tolist():
                batch = whole.filter(pa.array(whole.column("dim").to_numpy() == dim))
                table = pivots.get(dim, np.zeros((0, dim)))
                k = min(prefix, len(table))
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    own = np.full((part.num_rows, prefix), -1, dtype=np.int64)
                    if k:
                        near = unit(part.column("v"), dim) @ table.T
                        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                        own[:, :k] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                    lists = own[:, :k] if k else np.full((part.num_rows, 1), _NO_PIVOT)
                    rows = pa.array(np.repeat(np.arange(part.num_rows), lists.shape[1]))
                    described = pa.array([r.astype("<i4").tobytes() for r in own], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array((dim << 32) + lists.ravel()), part.column("node").take(rows), described.take(rows)], names=["k", "node", "pivots"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        for t, starts in whole_runs(batches, ["k", "bi", "bj"], 1024):
            if len(starts) == t.num_rows:
                continue
            own = np.frombuffer(b"".join(t.column("pivots").to_pylist()), "<i4").reshape(t.num_rows, prefix).astype(np.int64)
            b, same = t.column("b").to_numpy(), t.column("bi").to_numpy() == t.column("bj").to_numpy()
            p, q = _candidates(starts, t.column("k").to_numpy() & _NO_PIVOT, own, lambda x, y: same[x] | (b[x] != b[y]), shared, shift)  # noqa: B023
            if len(p):
                yield t, p, q, np.unique(np.concatenate([p, q]))

    @lean
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, _, rows in runs(batches):
            yield t.take(pa.array(rows)).combine_chunks().to_batches()[0]

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, p, q, _ in runs(batches):
            dim = (t.column("k").to_numpy() >> 32)[p]
            near = np.zeros(len(p), dtype=bool)
            for d in np.unique(dim).tolist():
                of_dim = np.flatnonzero(dim == d)
                rows, at = np.unique(np.concatenate([p[of_dim], q[of_dim]]), return_inverse=True)
                x = unit(t.column("v").combine_chunks().take(pa.array(rows)), d)
                for a in range(0, len(of_dim), 1 << 15):
                    own = of_dim[a : a + (1 << 15)]
                    near[own] = np.einsum("ij,ij->i", x[at[a : a + len(own)]], x[at[len(of_dim) + a : len(of_dim) + a + len(own)]]) >= threshold
            p, q = p[near], q[near]
            if len(p):
                n, copies, node = t.num_rows, t.column("n").to_numpy(), t.column("node").to_numpy()
                links = np.bincount(p, weights=copies[q], minlength=n) + np.bincount(q, weights=copies[p], minlength=n)
                label, some = local_components(n, p, q), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[label[some]])], names=["node", "links", "root"])

    keys = classes.select("node", "dim", "v").mapInArrow(index, "k long, node long, pivots binary")
    posted = block_pairs(keys, "k", "node", block, total * prefix).select("k", "bi", "bj", "b", "node", "pivots")
    found = posted.mapInArrow(members, "k long, bi int, bj int, b int, node long, pivots binary")
    brought = found.join(classes.select("node", "n", "v"), "node").repartition("k", "bi", "bj").sortWithinPartitions("k", "bi", "bj")
    return brought.select("k", "bi", "bj", "b", "node", "pivots", "n", "v").mapInArrow(verify, "node long, links long, root long")
