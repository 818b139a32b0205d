"""SimHash near-dedup (4): fingerprints over word shingles, linked through a pigeonring filter; by exact Jaccard, bands add the pairs too far apart for it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import block_pairs, deal, for_each_piece, hot_join, hot_keys, pairs_of_runs, whole_runs
from .common import discard, lean, materialize, text_batches
from .graph import components, local_components

_LANES = np.uint64(0x0101010101010101)
_BAND = 4  # min-hashes of a band
_SEGMENT = 4  # bits of a segment of the ring
_SHORT = 1 << 26  # fingerprints up to which the shorter keys make short buckets
_RING = 3  # bits of the first 64 within which the ring finds all sets


def _mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of ``h`` (rows, words): an array (words, 64)."""
    out = np.zeros((h.shape[1], 8, 8), dtype=np.int64)
    for a in range(0, len(h), 255):  # a byte lane counts to 255
        part = h[a : a + 255]
        for b in range(8):
            lanes = ((part >> np.uint64(b)) & _LANES).sum(axis=0, dtype=np.uint64)
            out[:, :, b] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1, 64)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a whole text. A-Z are lower-cased; words are runs without ASCII white space."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(tokens))
    ends, begins = ends[k - 1 :].tolist(), begins[: len(begins) - k + 1].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, ends, strict=True)), dtype=np.uint64, count=len(ends))


def _fingerprint(hashes: np.ndarray, words: int, chunk: int = 1 << 16) -> bytes:
    counts, n = np.zeros((words, 64), dtype=np.int64), len(hashes)
    for at in range(0, n, chunk):
        h = hashes[at : at + chunk]
        many = np.empty((len(h), words), dtype=np.uint64)
        many[:, 0] = h
        for w in range(1, words):
            many[:, w] = _mix(h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        counts += _bit_counts(many)
    bits = counts * 2 > n
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(">u8").tobytes()


def fingerprint(text: str | None, shingle: int, words: int, distinct: bool = False, seed: int = 42, chunk: int = 1 << 16) -> bytes:
    """SimHash of a whole text, ``words`` x 64 bits, most significant byte of each word first.

    Word 0 is over the hash of each shingle, the others over mixes of it. A bit is 1 if set in
    over half of the shingles; with ``distinct`` a shingle counts once however often the text repeats it.
    """
    hashes = shingle_hashes(text, shingle, seed)
    return _fingerprint(np.unique(hashes) if distinct else hashes, words, chunk)


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """Keys of ``bands`` bands, each of ``_BAND`` min-hashes of a set; sets of Jaccard J agree in one with probability J ** _BAND."""
    if not len(hashes):
        return np.zeros(bands, dtype=np.uint64)
    odd = _mix(np.arange(1, bands * _BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    low = np.array([_mix((hashes ^ (m >> np.uint64(7))) * m).min() for m in odd]).reshape(bands, _BAND)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(_BAND):
        key = _mix((key ^ low[:, i]) + np.uint64(0x9E3779B97F4A7C15))
    return key


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, words: int = 1, distinct: bool = False, bands: int = 0) -> DataFrame:
    """``docs`` with a key of the row, ``__row``, and of its class, ``__class``; ``__fp``, ``__bands`` and ``__size``.

    Null and empty texts have the zero fingerprint. A class is a fingerprint or, with ``bands``,
    a set of distinct shingles. ``__row`` is settled once the result is written.
    """
    text_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__fp", T.BinaryType()), T.StructField("__class", T.BinaryType()), T.StructField("__bands", T.BinaryType()), T.StructField("__size", T.LongType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[bytes, bytes, bytes | None, int]] = []
            for t in batch.column(read):
                hashes = shingle_hashes(t.as_py(), shingle)
                hashes = np.unique(hashes) if distinct else hashes
                fp = _fingerprint(hashes, words)
                made.append((fp, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if bands else fp, band_keys(hashes, bands).tobytes() if bands else None, len(hashes)))
            new = [pa.array([m[i] for m in made], type=kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int64()))]
            rest = [batch.column(n) for n in docs_columns] + [batch.column("__row")]
            yield pa.RecordBatch.from_arrays([*rest, *new], names=names)

    docs_columns, names = docs.columns, schema.names
    read = text_col if isinstance(docs.schema[text_col].dataType, T.StringType) else "__text"
    return docs.withColumn("__row", F.monotonically_increasing_id()).withColumn(read, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _popcounts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def ring_keys(fps: np.ndarray, distance: int, halves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints, given as rows of bytes, and the ring segment each begins at: arrays (rows, keys) and (keys,).

    The ring has segments of ``_SEGMENT`` bits. From some start no bit differs in as many
    segments as have a budget of 0, and at most one in those after them that have a budget
    under 2, so that one half of these agrees too. A key is a start and the first segments, and
    with ``halves`` either half: twice the keys, which are the longer.
    """
    n, bits = len(fps), np.unpackbits(fps, axis=1)
    width = bits.shape[1]
    m = width // _SEGMENT
    zero = (m if not distance else min(m, -(-m // distance) - 1)) * _SEGMENT
    one = (m if not distance else min(m, -(-2 * m // distance) - 1)) * _SEGMENT
    half = (zero + one + 1) // 2
    out, start = [], []
    for s in range(m if distance else 1):
        ring = np.roll(bits, -s * _SEGMENT, axis=1)
        for side, (a, b) in enumerate(((zero, half), (half, one))[: 1 + (one > half)] if halves else ((zero, zero),)):
            packed = np.packbits(np.concatenate([ring[:, :zero], ring[:, a:b]], axis=1), axis=1)
            packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
            key = np.full(n, 2 * s + side + 1, dtype=np.uint64)
            for i in range(packed.shape[1]):
                key = _mix((key ^ packed[:, i]) + np.uint64(0x9E3779B97F4A7C15))
            out.append(key)
            start.append(s)
    return np.stack(out, axis=1).view(np.int64), np.array(start, dtype=np.int32)


def links(fps: DataFrame, words: int, distance: int, chain: int | None = None, block: int = 1024, total: int = 0) -> DataFrame:
    """Links ``(src, dst)`` that connect the distinct fingerprints ``fps(node, fp)`` within ``distance`` bits.

    Pigeonring: the fingerprint is a ring of m segments of 4 bits. If at most t bits differ,
    some start has, for every chain length l, at most l*t/m differences in the l segments from
    it. Fingerprints meet in the buckets of ``ring_keys``; pairs of a bucket must then hold the
    chain condition up to ``chain`` segments (all by default), and only those left have all
    bits compared. No pair is missed; ``distance`` must be under m, 16 for 64 bits. With 64 bits
    and 3 of them differing there are 16 keys of 20 bits, or, if there are over ``_SHORT``
    fingerprints (``total``), 32 of 30 bits, so that buckets stay short. A run of a bucket gives one link for each of its linked fingerprints, not all pairs.
    """
    m = words * 64 // _SEGMENT
    if not 0 <= distance < m:
        raise ValueError(f"distance must be under {m} for {words * 64} bits")
    chain, halves = min(chain or m, m), total > _SHORT
    nibble = np.array([x.bit_count() for x in range(16)], dtype=np.int16)

    @lean
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                key, start = ring_keys(np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(part.num_rows, words * 8), distance, halves)
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(start)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(start, part.num_rows)), part.column("node").take(rows), part.column("fp").take(rows)], names=["k", "start", "node", "fp"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, ["k", "bi", "bj"]):
            n = t.num_rows
            if len(starts) == n:
                continue
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), dtype=np.uint8).reshape(n, words * 8)
            segments = np.stack([fp >> 4, fp & 15], axis=2).reshape(n, m)
            wide = fp.view(np.uint64)
            first = t.column("start").to_numpy().astype(np.int64)
            b, same = t.column("b").to_numpy(), t.column("bi").to_numpy() == t.column("bj").to_numpy()

            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                ok = np.flatnonzero(same[x] | (b[x] != b[y]))
                sums = np.zeros(len(ok), dtype=np.int16)
                for step in range(chain):
                    s = (first[x[ok]] + step) % m
                    sums = sums + nibble[segments[x[ok], s] ^ segments[y[ok], s]]
                    keep = sums <= (step + 1) * distance // m
                    ok, sums = ok[keep], sums[keep]
                full = _popcounts(wide[x[ok]] ^ wide[y[ok]]).sum(axis=1) <= distance
                out = np.zeros(len(x), dtype=bool)
                out[ok[full]] = True
                return out

            x, y = pairs_of_runs(starts, n, near)
            if len(x):
                label = local_components(n, x, y)
                node = t.column("node").to_numpy()
                moved = np.flatnonzero(label != np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["src", "dst"])

    keys = fps.select("node", "fp").mapInArrow(explode, "k long, start int, node long, fp binary")
    per_row = len(ring_keys(np.zeros((1, words * 8), np.uint8), distance, halves)[1])
    return block_pairs(keys, "k", "node", block, total * per_row).select("k", "bi", "bj", "b", "start", "node", "fp").mapInArrow(compare, "src long, dst long")


def ring_candidates(classes: DataFrame, distance: int = _RING, chain: int | None = None, block: int = 1024, total: int = 0) -> DataFrame:
    """Links ``(src, dst)`` that connect all sets ``classes(node, fp)`` whose first 64 bits differ in at most ``distance``.

    ``links`` over the distinct fingerprints; sets that share one are linked to the first of them. ``classes`` is read more than once, so write it before.
    """
    of_fp = classes.select("node", F.substring("fp", 1, 8).alias("fp"))
    least = materialize(of_fp.groupBy("fp").agg(F.min("node").alias("least")), "ring")
    same = hot_join(of_fp, least, ["fp"], ["node"], total=total or None).where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst"))
    return same.union(links(least.select(F.col("least").alias("node"), "fp"), 1, distance, chain, block, total))


def candidates(classes: DataFrame, words: int, similarity: float, block: int = 1024, total: int = 0) -> DataFrame:
    """Links ``(src, dst)`` that connect all sets ``classes(node, fp, bands, size)`` that may have a Jaccard of ``similarity``.

    Sets meet where they agree in a band. ``total`` is the number of their bands, counted unless given. A pair of them is a candidate within the distance that
    stands for ``similarity`` and 6.5 standard deviations of it; sets under 32 shingles, whose
    bits tie often, at any distance.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = math.ceil(words * 64 * p + 6.5 * math.sqrt(words * 64 * p * (1 - p)))

    @lean
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype=np.int64)
            at = pa.array(np.repeat(np.arange(n), len(key) // n))
            rest = batch.select(["node", "fp", "size"])
            for a in range(0, len(key), 1 << 16):
                part = rest.take(at.slice(a, 1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)]), *part.columns], names=["k", "node", "fp", "size"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, ["k", "bi", "bj"]):
            n = t.num_rows
            if len(starts) == n:
                continue
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), dtype=np.uint64).reshape(n, words)
            size, node = t.column("size").to_numpy(), t.column("node").to_numpy()

            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                least, most = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                return (least >= similarity * most - 1) & ((least < 32) | (_popcounts(fp[x] ^ fp[y]).sum(axis=1) <= limit))

            x, y = pairs_of_runs(starts, n, near)
            if len(x):
                label = local_components(n, x, y)
                moved = np.flatnonzero(label != np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["src", "dst"])

    keys = classes.select("node", "fp", "bands", "size").mapInArrow(explode, "k long, node long, fp binary, size long")
    return block_pairs(keys, "k", "node", block, total).select("k", "bi", "bj", "node", "fp", "size").mapInArrow(compare, "src long, dst long")


def similar(groups: DataFrame, shingle: int, similarity: float, block: int = 256) -> DataFrame:
    """Links ``(src, dst)`` that connect the texts of ``groups(root, node, text)`` whose distinct shingles have a Jaccard of ``similarity`` or more.

    Every pair of a group is decided by its exact Jaccard, unless links before it connect the two.
    """

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, ["root", "bi", "bj"], block):
            node, text = t.column("node").to_numpy(), t.column("text")
            for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
                n = int(z - a)
                if n < 2:
                    continue
                sets = [np.unique(shingle_hashes(text[i].as_py(), shingle)) for i in range(a, z)]
                size = np.array([len(x) for x in sets])
                at = np.concatenate([[0], np.cumsum(size)])
                ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
                mark = np.zeros(len(ids) + 1, dtype=bool)
                label, src, dst = np.arange(n), [], []
                for i in range(n - 1):
                    later = np.arange(i + 1, n)
                    todo = later[(label[later] != label[i]) & (np.minimum(size[later], size[i]) >= similarity * np.maximum(size[later], size[i]) - 1)]
                    if not len(todo):
                        continue
                    mark[ids[at[i] : at[i + 1]]] = True
                    for j in todo:
                        if label[j] == label[i]:
                            continue
                        both = int(np.count_nonzero(mark[ids[at[j] : at[j + 1]]]))
                        if both / max(1, size[i] + size[j] - both) >= similarity:
                            src.append(node[a + i])
                            dst.append(node[a + j])
                            label[label == label[j]] = label[i]
                    mark[ids[at[i] : at[i + 1]]] = False
                if src:
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    text_batches(groups.sparkSession)
    return block_pairs(groups, "root", "node", block).select("root", "bi", "bj", "node", "text").mapInArrow(compare, "src long, dst long")


def _members(roots: DataFrame) -> DataFrame:
    """``roots(node, root)`` with the roots themselves."""
    return roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def _grouped(docs: DataFrame, text_col: str = "text", whole: bool = True, shingle: int = 5, words: int = 8, distance: int | None = None, similarity: float = 0.8, chain: int | None = 4, distinct: bool = True, block: int = 1024) -> tuple[DataFrame, DataFrame, int]:
    """``fingerprints`` of ``docs``, written, the component of each class with its number of rows, written: ``(__class, __root, __n)``, and the number of classes."""
    exact = distance is None
    bands = math.ceil(math.log(1e-7) / math.log(1 - similarity**_BAND)) if exact and similarity < 1 else int(exact)
    rows = fingerprints(docs, text_col, shingle, words, distinct or exact, bands)
    rows = materialize(rows if exact or whole else rows.drop(text_col), "fingerprints")
    classes = rows.groupBy("__class").agg(F.min("__row").alias("row"), F.count("*").alias("n"), F.first(F.struct("__fp", "__bands", "__size")).alias("x"))
    classes = classes.select("__class", "row", "n", F.col("x.__fp").alias("fp"), F.col("x.__bands").alias("bands"), F.col("x.__size").alias("size"), F.monotonically_increasing_id().alias("node"))
    classes = materialize(classes, "classes")
    total = classes.count()
    if exact:
        near = ring_candidates(classes, chain=chain, block=block, total=total).union(candidates(classes, words, similarity, block, total * bands))
        found = _members(components(near))
        of_row = classes.select("node", "row").join(found, "node")
        texts = rows.select(F.col("__row").alias("row"), F.col(text_col).cast("string").alias("text"))
        met = materialize(texts.join(of_row, "row").select("root", "node", "text"), "candidates")
        roots = components(similar(met, shingle, similarity))
        discard(met)
    else:
        roots = components(links(classes, words, distance, chain, block, total))
    of_class = classes.select("__class", F.col("n").alias("__n"), "node").join(_members(roots), "node", "left").select("__class", F.coalesce("root", "node").alias("__root"), "__n")
    of_class = materialize(of_class, "roots", total)
    discard(classes)
    return rows, of_class, total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` and ``component_id``, the smallest id reachable by links.

    By default texts are linked whose distinct five-word shingles have a Jaccard of at least
    ``similarity`` (0.8): ``ring_candidates`` finds the pairs of near fingerprints, ``candidates``
    those further apart, ``similar`` decides them. With a ``distance``,
    fingerprints of ``words`` x 64 bits are linked within so many bits instead (see ``links``).
    Documents of one class (so all exact copies, and all empty and null texts) are linked; only
    classes are compared. Null ids are never a component's id unless it has no other. Repeated
    rows are repeated. Empty table: no rows.
    """
    rows, of_class, total = _grouped(docs.select(id_col, text_col), text_col, False, **how)
    low = materialize(rows.groupBy("__class").agg(F.min(id_col).alias("rep")).join(of_class, "__class"), "least", total)
    low = hot_join(low.select("__class", "__root", "__n"), low.groupBy("__root").agg(F.min("rep").alias("component_id")), ["__root"], ["__class"])
    low = materialize(low.select("__class", "__n", "component_id"), "components", total)
    hot = hot_keys(low, ["__class"], "__n", low.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
    out = deal(rows, hot, ["__class"], ["__row"]).join(for_each_piece(low.drop("__n"), hot, ["__class"]), ["__class", "__s"])
    return out.select(id_col, F.col("__fp").alias("fp"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``: the one of the smallest id, null ids last.

    Rows are told apart by a key of their own, so ids may be null or repeated.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that none of the frame's names clashes
    rows, of_class, total = _grouped(docs.toDF(*names.values()), names[text_col], **how)
    own, id_col = list(names.values()), names[id_col]
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("__row")))
    of_each = rows.groupBy("__class").agg(first.alias("x")).join(of_class, "__class")
    kept = materialize(of_each.groupBy("__root").agg(F.min("x").alias("x")).select(F.col("x.__row").alias("__row")), "kept", total)
    return rows.join(kept, "__row", "left_semi").select(*own).toDF(*docs.columns)
