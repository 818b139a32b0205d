"""Benchmark decontamination (3): pigeonhole edit matching with Myers verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import hot_join
from .common import lean, materialize, text_batches, unused


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Lowest edit distance of ``pattern`` to a substring of ``text`` and the first end of such a substring.

    Bit-parallel (Myers 1999, Hyyro's form); None if the distance is over ``limit``.
    """
    m = len(pattern)
    if not m:
        return None
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    pv, mv, d, best, end = full, 0, m, limit + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            d += 1
        elif mh & high:
            d -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if d < best:
            best, end = d, j + 1
    return (best, end) if end >= 0 else None


def _joined(a: str, b: str) -> bool:
    """Whether neighbours belong to one word."""
    return a.isalnum() and b.isalnum()


class Matcher:
    """Finds every item of a list within its error budget in whole texts.

    An item of n characters may differ by ``n * rate`` edits; cut into one piece more, at least
    one piece occurs unchanged. Pieces are found by one automaton; each hit opens a window
    around the item's place there, overlapping windows of an item are joined, and the distance
    decides. An item under ``min_chars`` characters must occur unchanged and as whole words.
    """

    def __init__(self, items: list[tuple[object, str]], rate: float, min_chars: int = 0):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate) if len(t) >= min_chars else 0) for i, t in items if t]
        self.min_chars = min_chars
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for j in range(k + 1):
                a, b = j * len(t) // (k + 1), (j + 1) * len(t) // (k + 1)
                pieces.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, v in pieces.items():
            self.automaton.add_word(p, (len(p), v))
        if pieces:
            self.automaton.make_automaton()
        self.some = bool(pieces)

    def __call__(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end) of the best match of each item, in the normalised text."""
        text = normal(text)
        if not self.some or not text:
            return []
        places: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, a in uses:
                places.setdefault(n, []).append(end + 1 - size - a)
        out = []
        for n, starts in places.items():
            item, pattern, k = self.items[n]
            if found := best_match(text, pattern, k, starts, len(pattern) < self.min_chars):
                out.append((item, *found))
        return sorted(out, key=lambda x: (str(x[0]), x[2]))


def best_match(text: str, pattern: str, budget: int, starts: list[int], words: bool) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best match of ``pattern`` within ``budget`` about places where it may begin; with ``words``, unchanged and as whole words."""
    if words:
        size = len(pattern)
        whole = lambda s: text[s : s + size] == pattern and not (s and _joined(text[s - 1], text[s])) and not _joined(text[s + size - 1], text[s + size : s + size + 1])
        at = next((s for s in sorted(set(starts)) if s >= 0 and whole(s)), None)
        return None if at is None else (0, at, at + size)
    best = None
    lo = hi = None
    for s in [*sorted(set(starts)), None]:
        if lo is not None and (s is None or s - budget > hi):
            found = myers(pattern, text[max(0, lo) : hi], budget)
            if found and (best is None or found[0] < best[0]):
                best = (found[0], max(0, lo) + found[1])
                if not found[0]:
                    break
            lo = None
        if s is not None:
            lo = s - budget if lo is None else lo
            hi = s + len(pattern) + budget
    if not best:
        return None
    d, end = best
    back = myers(pattern[::-1], text[max(0, end - len(pattern) - budget) : end][::-1], d)
    # the reversed match must end where the forward one does: anchored, it starts at index 0
    return d, max(0, end - (back[1] if back else len(pattern))), end


#: Seeds of pieces have this many characters at most; their filter has this many bits.
_SEED, _FILTER = 16, 1 << 26


def seed_keys(text: str) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 1, 2, 4, 8 and 16 characters, by their place."""
    h = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    out, size = {}, 1
    while size <= min(_SEED, len(text)):
        out[size] = _mix(h + np.uint64(size))
        h = _mix(h[: len(h) - size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _joined_matches(rows: DataFrame, items: DataFrame, rate: float, min_chars: int) -> DataFrame:
    """``(row, item, distance, start, end)`` for ``rows(row, text)`` and ``items(no, item, text)``, both written, by joins of pieces.

    Each piece of an item has a seed, its first characters (a power of 2 of them). Places of a
    document pass a bitmap of all seeds, of fixed size, before their join with the seeds, which
    are dealt where one is hot; then each document meets the texts of its candidates, and the
    distance decides as in ``Matcher``.
    """

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, nos, offs, sizes = [], [], [], []
            for no, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = normal(t)
                k = int(len(t) * rate) if len(t) >= min_chars else 0
                keys = seed_keys(t)
                for j in range(k + 1 if t else 0):
                    a, b = j * len(t) // (k + 1), (j + 1) * len(t) // (k + 1)
                    size = min(_SEED, 1 << ((b - a).bit_length() - 1))
                    seeds.append(int(keys[size][a].view(np.int64)))
                    nos.append(no)
                    offs.append(a)
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(nos, pa.int64()), pa.array(offs, pa.int64()), pa.array(sizes, pa.int32())], names=["seed", "no", "off", "size"])

    seeds = materialize(items.select("no", "text").mapInArrow(cut, "seed long, no long, off long, size int"), "seeds")
    sizes = [r[0] for r in seeds.select("size").distinct().collect()]
    word = F.shiftrightunsigned("seed", 6).bitwiseAND(_FILTER // 64 - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("seed").bitwiseAND(63).cast("int"))
    told = seeds.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most _FILTER / 64 rows
    bits = np.zeros(_FILTER // 64, dtype=np.uint64)
    bits[told.column("word").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for size, keys in seed_keys(normal(t)).items():
                    if size in sizes:
                        at = np.flatnonzero(bits[(keys >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (keys & np.uint64(63)) & np.uint64(1))
                        for a in range(0, len(at), 1 << 16):
                            part = at[a : a + (1 << 16)]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row)), pa.array(keys[part].view(np.int64)), pa.array(part)], names=["row", "seed", "pos"])

    hits = materialize(rows.select("row", "text").mapInArrow(scan, "row long, seed long, pos long"), "seed-hits")
    met = hot_join(hits, seeds.select("seed", "no", "off"), ["seed"], ["row", "pos"])
    places = materialize(met.groupBy("row", "no").agg(F.collect_set(F.col("pos") - F.col("off")).alias("starts")), "places")
    named = hot_join(places, items.select("no", "item", "text"), ["no"], ["row"])
    found = named.groupBy("row").agg(F.collect_list(F.struct("item", "text", "starts")).alias("c"))
    item_type = items.schema["item"].dataType

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, t, c in zip(*(batch.column(n).to_pylist() for n in ("row", "text", "c")), strict=True):
                text = normal(t)
                for x in c:
                    pattern = normal(x["text"])
                    short = len(pattern) < min_chars
                    if best := best_match(text, pattern, 0 if short else int(len(pattern) * rate), x["starts"], short):
                        out.append((row, x["item"], *best))
            kinds = (pa.int64(), to_arrow_type(item_type), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["row", "item", "distance", "start", "end"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("item", item_type), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return found.join(rows.select("row", "text"), "row").select("row", "text", "c").mapInArrow(verify, schema)


def _small(benchmark: DataFrame, item: Column, item_text: str, most: int) -> list[tuple[object, str]] | None:
    """Items ``(item, normal text)`` if all have no more than ``most`` characters together, else None."""
    rows = benchmark.select(item.alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    return [(r[0], normal(r[1])) for r in rows.collect()] if size <= most else None


def _large(docs: DataFrame, benchmark: DataFrame, item: Column, item_text: str) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with a key, the key's name, and ``items(no, item, text)``, both written."""
    key = unused(docs.columns, "__key")
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    items = benchmark.select(item.alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    return rows, key, materialize(items.withColumn("no", F.monotonically_increasing_id()), "items")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.05, min_chars: int = 20, chunk_chars: int = 2_000_000) -> DataFrame:
    """``(id_col, item_id, distance, start, end)``: the best match of every benchmark item in every document.

    Both texts are compared in lower case with single spaces; places are in that form of the
    document. A benchmark of up to ``chunk_chars`` characters, which is measured first, is one
    automaton in every task, and documents are never shuffled. A larger one stays a table: its
    pieces are joined with the documents' (see ``_joined_matches``), and nothing of it is in the
    driver. Items under ``min_chars`` characters match unchanged and as whole words only; empty
    or null ones match nothing. Repeated items and documents give repeated rows; a document
    without a match gives none, and so does an empty table. Extra columns are dropped. Where
    both ids have one name, the item's has ``benchmark_`` before it; ids may not be called
    distance, start or end.
    """
    text_batches(docs.sparkSession)
    item_type = benchmark.schema[item_id].dataType
    names = [id_col, item_id if item_id != id_col else f"benchmark_{item_id}"]
    if {"distance", "start", "end"} & {n.lower() for n in names}:
        raise ValueError("ids may not be called distance, start or end")
    text = F.col(text_col).cast("string")
    items = _small(benchmark, F.col(item_id), item_text, chunk_chars)
    if items is None:
        rows, key, listed = _large(docs.select(F.col(id_col).alias("id"), text.alias("text")), benchmark, F.col(item_id), item_text)
        rows = rows.withColumnRenamed(key, "row")
        found = rows.select("row", "id").join(_joined_matches(rows, listed, rate, min_chars), "row").select("id", "item", "distance", "start", "end")
        return found.withColumnsRenamed({"id": names[0], "item": names[1]})
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("item", item_type), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    batch_type = to_arrow_type(item_type)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate, min_chars)
        for batch in batches:
            at, found = [], []
            for n, t in enumerate(batch.column(1)):
                for f in matcher(t.as_py()):
                    at.append(n)
                    found.append(f)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([f[0] for f in found], batch_type), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())],
                names=["id", "item", "distance", "start", "end"],
            )

    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, schema).withColumnsRenamed({"id": names[0], "item": names[1]})


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_chars: int = 20, text_col: str = "text", item_text: str = "text", chunk_chars: int = 2_000_000) -> DataFrame:
    """``docs`` without the documents in which an item matches; all columns and repeated rows of the others stay.

    With a benchmark of up to ``chunk_chars`` this is narrow: the search of ``matches`` runs on
    each row and rejects it on the spot. With a larger one the rows are written with a key, and
    those of the joined matches are taken out by an anti join.
    """
    text_batches(docs.sparkSession)
    items = _small(benchmark, F.lit(None).cast("int"), item_text, chunk_chars)
    if items is None:
        rows, key, listed = _large(docs, benchmark, F.lit(None).cast("int"), item_text)
        leaks = _joined_matches(rows.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text")), listed, rate, min_chars)
        return rows.join(leaks.select(F.col("row").alias(key)), key, "left_anti").select(*docs.columns)
    flag, at = unused(docs.columns, "__leak"), docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate, min_chars)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bool(matcher(t.as_py())) for t in batch.column(at)], pa.bool_())], names=[*batch.schema.names, flag])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])).where(~F.col(flag)).drop(flag)
