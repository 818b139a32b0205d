"""Packing (1): cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches, trim

#: Words of Latin-1 letters and ASCII marks after them: to the tokenizer a token of letters and one of marks, already composed.
_PLAIN = "^(?P<core>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
#: Normaliser and splitter of vocabularies that may be encoded by words: white space always parts tokens, and case and composition are all that changes.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Bytes of text that are encoded together, and words of them that the tokenizer sees in one call.
_AT_ONCE = 4_000_000
_WORDS_AT_ONCE = 4096


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of stretches [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordEncoder:
    """Token ids of whole texts, by way of their distinct white-space-free words where the vocabulary allows it.

    That is so where its settings are ``_BY_WORDS``; with any others, whole texts are encoded.
    Such a splitter never joins characters over white space, so ids of a text
    are the ids of its words in order; each distinct word is encoded once and remembered, until
    there are ``remember`` of them; then only those of the texts at hand stay. Plain
    words are looked up as letters in lower case and marks, which is what the tokenizer's own
    normaliser and splitter make of them; all others pass through it whole.
    """

    def __init__(self, tokenizer_path: str, remember: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(tokenizer_path), Tokenizer.from_file(tokenizer_path)
        settings = json.loads(self.tokenizer.to_str())
        self.by_words = all(settings[k] == v for k, v in _BY_WORDS.items()) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"])
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.remember = remember
        self.known: dict[str, int] = {}
        self.last: list[str] = []
        self.pool, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, vocabulary: list[str]) -> None:
        """Forget all words but these."""
        words = [w for w in vocabulary if w in self.known]
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        self.pool, self.sizes = self.pool[_stretches(self.starts[at], self.sizes[at])], self.sizes[at]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known = dict(zip(words, range(len(words)), strict=True))

    def rest(self) -> None:
        """Keep just the words of the texts encoded last, for the next task of this worker."""
        self._keep(self.last)
        self.last = []

    @staticmethod
    def _ids(tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words, one after another, and how many each has. An encoding takes far more memory than its ids."""
        pools, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), _WORDS_AT_ONCE):
            ids = [e.ids for e in tokenizer.encode_batch_fast(words[a : a + _WORDS_AT_ONCE].to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            pools.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes[-1].sum())))
        return np.concatenate(pools), np.concatenate(sizes)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        words = pa.array(words, pa.string())
        split = pc.extract_regex(words, _PLAIN)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        match = split.filter(pa.array(plain))
        cores = pc.utf8_lower(match.field("core")).dictionary_encode()
        marks = match.field("marks").dictionary_encode()
        odd = words.filter(pa.array(~plain))
        n_cores, n_marks = len(cores.dictionary), len(marks.dictionary)
        got = [self._ids(self.letters, cores.dictionary), self._ids(self.tokenizer, marks.dictionary), self._ids(self.tokenizer, odd)]
        pool, size = np.concatenate([g[0] for g in got]), np.concatenate([*(g[1] for g in got), [0]])
        part = np.full((len(words), 2), len(size) - 1, dtype=np.int64)
        part[plain, 0] = cores.indices.to_numpy()
        part[plain, 1] = marks.indices.to_numpy() + n_cores
        part[~plain, 0] = np.arange(len(odd)) + n_cores + n_marks
        return pool[_stretches((np.cumsum(size) - size)[part.ravel()], size[part.ravel()])], size[part].sum(axis=1)

    def _numbers(self, vocabulary: list[str]) -> np.ndarray:
        """Where each word's ids stand in ``starts`` and ``sizes``."""
        new = [w for w in vocabulary if w not in self.known]
        if len(self.known) + len(new) > self.remember:
            self._keep(vocabulary)
        known, self.last = self.known, vocabulary
        ids, sizes = self._encode(new)
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, ids])
        return np.fromiter(map(known.__getitem__, vocabulary), dtype=np.int64, count=len(vocabulary))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each closed by ``end_id``; and where each text ends."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            ids = [[*e.ids, end_id] for t in texts for e in self.tokenizer.encode_batch_fast([t.as_py()], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), dtype=np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())
        sizes, starts, pool = self.sizes[number], self.starts[number], self.pool
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        long = sizes[at]
        ends_of_words = np.cumsum(long)
        total = int(ends_of_words[-1]) if len(long) else 0
        from_pool = _stretches(starts[at], long)
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        text_ends = np.concatenate([[0], ends_of_words])[offsets[1:]]
        out = np.empty(total + len(texts), dtype=np.uint32)
        close = text_ends + np.arange(len(texts))
        keep = np.ones(len(out), dtype=bool)
        keep[close] = False
        out[keep] = pool[from_pool]
        out[close] = end_id
        return out, close + 1


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer_path: str) -> WordEncoder:
    """The encoder of this Python worker, which Spark keeps for later tasks."""
    return WordEncoder(tokenizer_path)


def pack_lengths(lengths: np.ndarray, seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Cost-balanced assignment of documents of these lengths: (document, start, length, sequence, offset).

    Blocks of ``seq_len`` tokens of a longer document are sequences of their own. What is left
    is taken in descending length; each goes to the sequence of the lowest attention cost
    (``linear * n + quadratic * n**2`` summed over its pieces) that has room. As many sequences
    are open as the tokens fill exactly; the tokens past the last full one form sequences whose
    lengths are powers of two, so nothing is padded. A piece that fits nowhere whole is cut.
    """
    out: list[tuple[int, int, int, int, int]] = []
    n_seq = 0
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths.tolist()):
        full = n // seq_len
        for k in range(full):
            out.append((d, k * seq_len, seq_len, n_seq, 0))
            n_seq += 1
        if n % seq_len:
            rest.append((n % seq_len, d, full * seq_len))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    tail = total % seq_len
    room = np.array([seq_len] * (total // seq_len) + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1], dtype=np.int64)
    capacity, cost = room.copy(), np.zeros(len(room))
    for n, d, start in rest:
        while n:
            fits = room >= n
            if fits.any():
                s = int(np.where(fits, cost, np.inf).argmin())
                take = n
            else:
                s = int(room.argmax())
                take = int(room[s])
            out.append((d, start, take, n_seq + s, int(capacity[s] - room[s])))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            start += take
            n -= take
    return out


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, end_id: int = 1, chunk_tokens: int = 1 << 21, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """Pack all documents into sequences of at most ``seq_len`` tokens; one row per piece.

    Narrow: a task tokenises its own rows and packs them ``chunk_tokens`` at a time, so nothing
    is shuffled, memory is bounded, and a lost task is simply run again with the same result
    (``sequence_id`` holds the partition in its upper bits). Columns: ``id_col`` as it came,
    ``start`` and ``length`` in the document's ids, ``doc_tokens`` with the end id,
    ``sequence_id``, ``offset`` there (gapless from 0), ``sequence_length``, ``ids`` (the piece,
    little-endian unsigned 32-bit). Null and empty texts are one end id. Repeated rows and ids
    are packed as often as they come. An empty table gives no rows. Other columns are dropped.
    """
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        base, held, n_held = TaskContext.get().partitionId() << 36, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held, n_held
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            end = np.concatenate([h[1] + s for h, s in zip(held, shift, strict=False)])
            begin = np.concatenate([[0], end[:-1]])
            name = pa.chunked_array([h[2] for h in held]).combine_chunks()
            got = np.array(pack_lengths(end - begin, seq_len, linear, quadratic), dtype=np.int64).reshape(-1, 5)
            sizes = np.bincount(got[:, 3], weights=got[:, 2]).astype(np.int64)
            for at in range(0, len(got), 20_000):
                g = got[at : at + 20_000]
                first = begin[g[:, 0]] + g[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [name.take(pa.array(g[:, 0])), *(pa.array(x) for x in (g[:, 1], g[:, 2], (end - begin)[g[:, 0]], base + g[:, 3], g[:, 4], sizes[g[:, 3]])), pa.array([ids[a : a + n].tobytes() for a, n in zip(first, g[:, 2], strict=True)], type=pa.binary())],
                    names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"],
                )
            base, held, n_held = base + len(sizes), [], 0

        def encoded(waiting: list[pa.RecordBatch]) -> None:
            nonlocal n_held
            if waiting:
                t = pa.Table.from_batches(waiting)
                ids, ends = encode(t.column(1).combine_chunks(), end_id)
                held.append((ids.astype("<u4", copy=False), ends, t.column(0).combine_chunks()))
                n_held += len(ids)
                trim()

        waiting, size = [], 0
        for batch in batches:
            own = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cut = np.unique(np.searchsorted(np.cumsum(own), np.arange(1, int(own.sum()) // _AT_ONCE + 1) * _AT_ONCE))
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if b > a:
                    waiting.append(batch.slice(a, b - a))
                    size += int(own[a:b].sum())
                if size >= _AT_ONCE:
                    encoded(waiting)
                    waiting, size = [], 0
                    if n_held >= chunk_tokens:
                        yield from flush()
        encoded(waiting)
        encode.rest()
        yield from flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, {PIECES}").withColumnRenamed("id", id_col)
