"""Suffix-array dedup (9): byte strings that repeat, found through longest-previous-factor arrays.

One suffix array over the corpus would be one task. Instead, every window of ``length`` bytes
has an anchor that depends on nothing but its own bytes (the least hashed ``gram`` within it),
so equal windows have equal anchors and meet in the group of that anchor. An anchor owns a
short run of windows, its context. Contexts with equal bytes (by two 64-bit hashes, of the
anchor and of all bytes) are one; the suffixes of the different contexts of a group are
sorted, and their longest previous factors tell which windows repeat. In a group of too many
contexts for one task each window is a context of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import deal, for_each_piece, hot_keys, whole_runs
from .common import discard, lean, materialize, text_batches

_PIECE = 1 << 20  # bytes hashed at once; positions in a piece fit in the low bits of a value
_LOW = np.uint64(_PIECE - 1)
_FACTOR = 0x9E3779B97F4A7C15 | 1
#: A group with more different contexts than this (about 300 bytes each) is too much for one task to sort.
HOT = 8192


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd value per byte, and powers of the factor and of its inverse modulo 2**64."""
    byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    inverse = pow(_FACTOR, -1, 1 << 64)
    powers = []
    for base in (_FACTOR, inverse):
        p = np.full(_PIECE + 1, base, dtype=np.uint64)
        p[0] = 1
        powers.append(np.cumprod(p, dtype=np.uint64))
    return byte, powers[0], powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with hash(a, b) = (P[b] - P[a]) * inverse ** a, for up to _PIECE bytes."""
    byte, power, _ = _tables()
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte[data] * power[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def anchors_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of ``length`` bytes in segments [begin, end) of a piece.

    Returns segment, anchor position, first window, number of windows, hash of the gram, hash
    of the context (all bytes of the windows, and where the anchor lies in them).
    """
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(2))
    n = len(data)
    if n < length:
        return none
    _, _, inverse = _tables()
    p = prefix_hashes(data)
    grams = _mix((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    count = np.maximum(ends - begins - length + 1, 0)
    total = int(count.sum())
    if not total:
        return none
    segment = np.repeat(np.arange(len(begins)), count)
    window = np.arange(total) + np.repeat(begins - (np.cumsum(count) - count), count)
    at = (least[window] & _LOW).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, total))
    anchor, begin = at[first], window[first]
    stop = begin + size - 1 + length
    context = (p[stop] - p[begin]) * inverse[begin]
    context = _mix(context + (((anchor - begin) << 16) + size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return segment[first], anchor, begin, size, grams[anchor], context


def _pieces(ends: np.ndarray, length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(begin, end, [(text, begin, end)]): stretches of the joined texts, each text's windows in exactly one."""
    held: list[tuple[int, int, int]] = []
    for i, end in enumerate(ends.tolist()):
        begin = int(ends[i - 1]) if i else 0
        if end - begin < length:
            continue
        while end - begin > _PIECE:
            if held:
                yield held[0][1], held[-1][2], held
                held = []
            yield begin, begin + _PIECE, [(i, begin, begin + _PIECE)]
            begin += _PIECE - length + 1
        if held and end - held[0][1] > _PIECE:
            yield held[0][1], held[-1][2], held
            held = []
        held.append((i, begin, end))
    if held:
        yield held[0][1], held[-1][2], held


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix among all, compared up to ``depth`` bytes (prefix doubling); equal prefixes tie."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        new = np.zeros(n, dtype=np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(new)
        return out

    width = min(8, depth)
    key = np.zeros(n, dtype=np.uint64)
    for b in range(width):
        key = (key << np.uint64(8)) | padded[b : b + n]
    rank = ranked(key)
    while width < depth:
        step = min(width, depth - width)
        other = np.zeros(n, dtype=np.int64)
        other[: n - step] = rank[step:] + 1 if step < n else 0
        rank = ranked(rank * (n + 1) + other)
        width += step
    return rank


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes the suffixes at a[i] and b[i] have in common, up to ``depth``."""
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    word = np.zeros(len(data) + 8, dtype=np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(word)]
    out, todo, at = np.full(len(a), depth, dtype=np.int64), np.arange(len(a)), 0
    while len(todo) and at < depth:
        x, y = (np.minimum(p[todo] + at, len(data)) for p in (a, b))
        differ = word[x] ^ word[y]
        end = differ != 0
        same = np.zeros(int(end.sum()), dtype=np.int64)
        for i in range(1, 8):
            same += differ[end] < np.uint64(1 << (64 - 8 * i))
        out[todo[end]] = at + same
        todo, at = todo[~end], at + 8
    return np.minimum(np.minimum(out, depth), len(data) - np.maximum(a, b))


def longest_previous_factors(order: np.ndarray, shared: np.ndarray, place: np.ndarray) -> np.ndarray:
    """LPF array: the longest prefix of each suffix that also begins at a smaller place.

    ``order`` is the suffix order and ``shared[i]`` what its i-th suffix has in common with the
    one before. The longest earlier match of a suffix is with the previous or the next one of a
    smaller place in suffix order; both are found for all suffixes at once by following the
    links of larger places, the shared prefix of a link being the least on its way.
    """
    best = np.zeros(len(order), dtype=np.int64)
    for backward in (False, True):
        at = place[order][::-1] if backward else place[order]
        reach = np.concatenate([[0], shared[:0:-1]]) if backward else np.concatenate([[0], shared[1:]])
        to = np.arange(len(at)) - 1
        todo = np.flatnonzero((to >= 0) & (at[to] >= at))
        while len(todo):
            over = to[todo]
            reach[todo] = np.minimum(reach[todo], reach[over])
            to[todo] = to[over]
            todo = todo[(to[todo] >= 0) & (at[to[todo]] >= at[todo])]
        np.maximum(best, reach[::-1] if backward else reach, out=best)
    out = np.empty_like(best)
    out[order] = best
    return out


def window_matches(data: np.ndarray, begin: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of ``depth`` bytes at ``begin``: which occur again, and which have a match at a smaller place.

    A window has one exactly if its longest previous factor reaches ``depth``; it occurs again
    exactly if it shares so much with a neighbour in suffix order.
    """
    rank = suffix_ranks(data, depth)[begin]
    order = np.argsort(rank * (int(place.max(initial=0)) + 1) + (int(place.max(initial=0)) - place))
    shared = np.zeros(len(order), dtype=np.int64)
    shared[1:] = common_prefixes(data, begin[order[:-1]], begin[order[1:]], depth)
    repeated = np.zeros(len(order), dtype=bool)
    again = shared >= depth
    repeated[order] = again | np.append(again[1:], False)
    return repeated, longest_previous_factors(order, shared, place) >= depth


def _one_of_each(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows ``(id, text, t1, t2, n)``: one for each text of the batch, with its least id and how often it is there."""
    t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
    order = np.lexsort((t2, t1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (t1[order][1:] != t1[order][:-1]) | (t2[order][1:] != t2[order][:-1])
    first = np.flatnonzero(new)
    none = batch.column("id").is_null().to_numpy(zero_copy_only=False)[order]
    ids = batch.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()[order]
    least = pa.array(np.minimum.reduceat(ids, first), mask=np.logical_and.reduceat(none, first))
    size = pa.array(np.diff(np.append(first, len(order))))
    kept = pa.array(order[first])
    return pa.RecordBatch.from_arrays([least, *(batch.column(c).take(kept) for c in ("text", "t1", "t2")), size], names=["id", "text", "t1", "t2", "n"])


def _anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(id, t1, t2, n, pk, g, c)`` for the anchors of every text; copies within a batch are combined, ``n`` counts them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = _one_of_each(batch)
            texts = batch.column("text").cast(pa.large_binary())
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for begin, end, held in _pieces(offsets[1:] - offsets[0], length):
                text, begins, ends = (np.array(x, dtype=np.int64) for x in zip(*held, strict=True))
                segment, anchor, first, size, gram_hash, context = anchors_of(data[offsets[0] + begin : offsets[0] + end], begins - begin, ends - begin, length, gram)
                own = text[segment]
                base = begin - (offsets[own] - offsets[0])
                packed = ((anchor + base) << 16) | ((anchor - first) << 8) | (size - 1)
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("id", "t1", "t2", "n")), pa.array(packed), pa.array(gram_hash.view(np.int64)), pa.array(context.view(np.int64))], names=["id", "t1", "t2", "n", "pk", "g", "c"])

    return docs.select("id", "text", "t1", "t2").mapInArrow(run, "id long, t1 long, t2 long, n long, pk long, g long, c long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted contexts ``(id, t1, t2, pk, g, c, m)``, each cut from the document that has them."""
    lists = wanted.groupBy("t1", "t2", "id").agg(F.collect_list(F.struct("pk", "g", "c", "m")).alias("w"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w")
            owner = pc.list_parent_indices(w).to_numpy(zero_copy_only=False)
            flat = w.flatten()
            pk = flat.field("pk").to_numpy(zero_copy_only=False)
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2]) if texts.buffers()[2] else memoryview(b"")
            begin = offsets[owner] + (pk >> 16) - (pk >> 8 & 255)
            stop = begin + (pk & 255) + length
            for a in range(0, len(pk), 20_000):
                z = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([flat.field("g")[z], flat.field("c")[z], batch.column("id").take(pa.array(owner[z])), flat.field("pk")[z], flat.field("m")[z], pa.array([bytes(data[x:y]) for x, y in zip(begin[z], stop[z], strict=True)], pa.binary())], names=["g", "c", "id", "pk", "m", "bytes"])

    lists = lists.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("id").alias("__id"), "w")
    same = (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")) & F.col("id").eqNullSafe(F.col("__id"))
    return docs.join(lists, same).select("id", "text", "w").mapInArrow(run, "g long, c long, id long, pk long, m long, bytes binary")


def _masks_by_suffixes(contexts: DataFrame, length: int) -> DataFrame:
    """(g, c, repeated, later): a bit per window of each context ``(g, c, id, at, bytes)``, by the suffix order of the group's contexts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(batches, ["g"], 4096):
            c, g = t.column("c").to_numpy(), t.column("g").to_numpy()
            by = np.lexsort((c, g))  # rows that share id and text have cut the same context
            again = np.zeros(len(c), dtype=bool)
            again[by[1:]] = (c[by][1:] == c[by][:-1]) & (g[by][1:] == g[by][:-1])
            if again.any():
                t = t.filter(pa.array(~again)).combine_chunks()
            parts = t.column("bytes").to_pylist()
            size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            begin, count = np.cumsum(size) - size, size - length + 1
            row = np.repeat(np.arange(len(parts)), count)
            within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            # places in order of document and position; windows of one context never equal each other
            ids = t.column("id").fill_null(np.iinfo(np.int64).min).to_numpy()
            place = np.empty(len(parts), dtype=np.int64)
            place[np.lexsort((t.column("at").to_numpy(), ids))] = np.arange(len(parts))
            found = window_matches(np.frombuffer(b"".join(parts), dtype=np.uint8), begin[row] + within, place[row], length)
            ends = np.cumsum(count)
            bits = [[np.packbits(x[b - n : b]).tobytes() for b, n in zip(ends, count, strict=True)] for x in found]
            yield pa.RecordBatch.from_arrays([t.column("g").combine_chunks(), t.column("c").combine_chunks(), pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary())], names=["g", "c", "repeated", "later"])

    return contexts.repartition("g").sortWithinPartitions("g").select("g", "c", "id", "at", "bytes").mapInArrow(run, "g long, c long, repeated binary, later binary")


def _masks_by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for hot groups, whose windows become contexts of their own: equal ones are those of one hash, counted with sums made before the shuffle."""

    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, inverse = _tables()
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                parts = batch.column("bytes").to_pylist()
                size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
                p, count = prefix_hashes(np.frombuffer(b"".join(parts), np.uint8)), size - length + 1
                row = np.repeat(np.arange(len(parts)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = (np.cumsum(size) - size)[row] + k
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(rows) for x in ("g", "c", "id")), pa.array(batch.column("at").to_numpy()[row] + k), pa.array(k), pa.array(_mix((p[begin + length] - p[begin]) * inverse[begin]).view(np.int64))], names=["g", "c", "id", "at", "k", "h"])

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[bytes]] = [[], []]
            for w in batch.column("w").to_pylist():
                n = max(x["k"] for x in w) + 1
                for name, to in zip(("repeated", "later"), out, strict=True):
                    bits = np.zeros(n, dtype=bool)
                    bits[[x["k"] for x in w if x[name]]] = True
                    to.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("c"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["g", "c", "repeated", "later"])

    every = contexts.select("g", "c", "id", "at", "bytes").mapInArrow(windows, "g long, c long, id long, at long, k long, h long")
    place = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "at")
    classes = every.groupBy("g", "h").agg((F.min("c") != F.max("c")).alias("repeated"), F.min(place).alias("first"), F.count("*").alias("r")).where("repeated")
    classes = materialize(classes, "window-classes")
    hot = hot_keys(classes, ["g", "h"], "r", classes.agg(F.sum("r")).first()[0] or 0)
    judged = deal(every, hot, ["g", "h"], ["c"]).join(for_each_piece(classes.drop("r"), hot, ["g", "h"]), ["g", "h", "__s"], "left")
    again = F.coalesce("repeated", F.lit(False))
    judged = judged.select("g", "c", F.struct("k", again.alias("repeated"), (again & F.coalesce(place > F.col("first"), F.lit(False))).alias("later")).alias("w"))
    return judged.groupBy("g", "c").agg(F.collect_list("w").alias("w")).mapInArrow(pack, "g long, c long, repeated binary, later binary")


def repeats(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``(t1, t2, __s, first_id, marks)`` for every text (t1, t2) with a repeated window, and the texts with many copies.

    ``docs(id, text, t1, t2)``. A mark has an anchor's windows, whether its context occurs more
    than once, whether this is the first of them, and bit masks of windows that other contexts
    share. A text that makes up over 1 / SHARE of all rows is in the second table, ``(t1, t2, __p)``,
    and has its marks once for each of ``__p`` pieces its rows are to be dealt to.
    """
    anchors = materialize(_anchor_table(docs, length, gram), "anchors")
    keys = materialize(anchors.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("r")).where("n > 1").select("g", "r"), "anchor-keys")
    hot = hot_keys(keys, ["g"], "r", anchors.count())
    # copies of a text have the same anchors: one row for all of them. A row's piece depends on its place, so grouping needs no other shuffle
    by_place = ["c", "t1", "t2", "pk"]
    again = deal(anchors, hot, ["g"], by_place).join(for_each_piece(keys.select("g"), hot, ["g"]), ["g", "__s"])
    places = materialize(again.groupBy("g", "__s", *by_place).agg(F.sum("n").alias("n"), F.min("id").alias("id")).drop("__s"), "places")
    discard(anchors, keys)
    order = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), (F.shiftright("pk", 16) - F.shiftright("pk", 8).bitwiseAND(255)).alias("at"), "t1", "t2", "pk", F.col("id").alias("own"))
    contexts = materialize(places.groupBy("g", "c").agg(F.sum("n").alias("n"), F.count("*").alias("r"), F.min(order).alias("rep")), "contexts")
    mixed = materialize(contexts.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    hot = hot_keys(mixed, ["g"], "m", contexts.count())
    wanted = deal(contexts, hot, ["g"], ["c"]).join(for_each_piece(mixed, hot, ["g"]), ["g", "__s"]).select("g", "c", "m", "rep.t1", "rep.t2", "rep.pk", F.col("rep.own").alias("id"))
    wanted = materialize(wanted, "wanted")
    found = materialize(_contexts(docs, wanted, length).withColumn("at", F.shiftright("pk", 16) - F.shiftright("pk", 8).bitwiseAND(255)), "context-bytes")
    discard(wanted)
    masks = _masks_by_suffixes(found.where(F.col("m") <= HOT), length).union(_masks_by_windows(found.where(F.col("m") > HOT), length))
    known = materialize(contexts.join(masks, ["g", "c"], "left").where("n > 1 or repeated is not null"), "masks")
    discard(found, mixed)
    hot = hot_keys(contexts, ["g", "c"], "r", places.count())
    marked = deal(places.select("g", "c", "t1", "t2", "pk", "id"), hot, ["g", "c"], ["t1", "t2", "pk"])
    marked = marked.join(for_each_piece(known.drop("r"), hot, ["g", "c"]), ["g", "c", "__s"]).drop("__s")
    copies = hot_keys(places.groupBy("t1", "t2").agg(F.max("n").alias("n")), ["t1", "t2"], "n", docs.count())
    first = (F.col("t1") == F.col("rep.t1")) & (F.col("t2") == F.col("rep.t2")) & (F.col("pk") == F.col("rep.pk"))
    mark = F.struct("pk", (F.col("n") > 1).alias("many"), first.alias("first"), "repeated", "later")
    marks = for_each_piece(marked.select("t1", "t2", "id", mark.alias("mark")), copies, ["t1", "t2"])
    return marks.groupBy("t1", "t2", "__s").agg(F.min("id").alias("first_id"), F.collect_list("mark").alias("marks")), copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "first", gram: int = 32) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that stay), ``n_bytes``, ``n_removed`` and ``spans`` (removed [start, end)).

    Texts are UTF-8 bytes (null: empty); a window is ``length`` bytes of one text. With
    ``keep="none"`` every byte of a window that also starts anywhere else goes, first copies
    included. With ``keep="first"`` the copy with the smallest (id, position) stays whole, and
    cuts keep to character boundaries; of equal texts the one with the smallest id is first
    (rows that also share the id count as one). Windows are judged on the input. Ids that aren't
    integers are ordered by a hash; null sorts first. Other columns stay; the four new ones replace columns of those
    names. Texts under ``length`` bytes are left alone.
    """
    if keep not in ("first", "none") or not gram < length < 256 + gram:
        raise ValueError("keep is first or none, and gram < length < gram + 256")
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own_id = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    named = docs.drop("kept", "n_bytes", "n_removed", "spans")
    rows = docs.select(F.struct(*[F.col(c) for c in named.columns]).alias("__row"), own_id.alias("__id"), text.alias("__text")).withColumn("t1", F.xxhash64("__text")).withColumn("t2", F.xxhash64(F.lit("second"), "__text"))
    narrow = rows.select(F.col("__id").alias("id"), F.col("__text").alias("text"), "t1", "t2")
    marks, copies = repeats(narrow, length, gram)
    joined = deal(rows, copies, ["t1", "t2"], ["__id"]).join(marks, ["t1", "t2", "__s"], "left").select("__row", "__id", "__text", "first_id", "marks")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("__row", named.schema), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids, firsts = batch.column("__id"), batch.column("first_id")
            for i in range(batch.num_rows):
                data = batch.column("__text")[i].as_py().encode("utf-8", "surrogatepass")
                marks = batch.column("marks")[i].as_py() or []
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                other = ids[i].as_py() != firsts[i].as_py()
                for m in marks:
                    pk, n = m["pk"], (m["pk"] & 255) + 1
                    start = (pk >> 16) - (pk >> 8 & 255)
                    if keep == "none" and m["many"] or keep == "first" and (other or not m["first"]):
                        edge[start] += 1
                        edge[start + n - 1 + length] -= 1
                    elif bits := m["repeated" if keep == "none" else "later"]:
                        k = start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:n])
                        np.add.at(edge, k, 1)
                        np.add.at(edge, k + length, -1)
                gone = np.zeros(len(data) + 2, dtype=np.int8)
                gone[1:-1] = np.cumsum(edge)[:-1] > 0
                begins, ends = np.flatnonzero(np.diff(gone) == 1).tolist(), np.flatnonzero(np.diff(gone) == -1).tolist()
                spans = []
                for a, b in zip(begins, ends, strict=True):
                    if keep == "first":
                        while a < b and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                    if b > a:
                        spans.append({"start": a, "end": b})
                left, at = [], 0
                for s in spans:
                    left.append(data[at : s["start"]])
                    at = s["end"]
                left.append(data[at:])
                for to, v in zip(out, (b"".join(left), len(data), sum(s["end"] - s["start"] for s in spans), spans), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=schema.names)

    return joined.mapInArrow(run, schema).select("__row.*", "kept", "n_bytes", "n_removed", "spans")
