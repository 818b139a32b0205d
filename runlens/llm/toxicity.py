"""Toxicity (2): weak supervision by lexicon and pattern voters under a generative label model."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, text_batches

_WORD = re.compile(r"\w+")
#: Patterns that vote beside the lexicon; all are language-free or common abuse phrasing.
PATTERNS = {
    "second person insult": re.compile(r"\byou(?:'re| are)? (?:an? )?(?:stupid|ugly|dumb|fool|idiot|pathetic|worthless)", re.I),
    "shut up": re.compile(r"\bshut (?:the \w+ )?up\b", re.I),
    "violence": re.compile(r"\b(?:kill|hurt|hate) (?:you|yourself|them)\b", re.I),
    "masked word": re.compile(r"\b\w+[*@#$]{2,}\w+\b"),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[ ,]*){6,}"),
    "exclamations": re.compile(r"!{3,}"),
}
#: Words and word pieces tried as lexicon entries: whole words, and beginnings and ends of this many letters.
PIECES = (4, 5, 6)


def features_of(word: str) -> list[str]:
    """Lexicon entries that a word could match."""
    out = ["=" + word]
    for n in PIECES:
        if len(word) > n:
            out += ["^" + word[:n], "$" + word[-n:]]
    return out


@dataclass
class Model:
    """A fitted scorer: voters, the label model's view of them, and the linear classifier."""

    lexicon: dict[str, int]
    patterns: list[str]
    prior: float = 0.5
    hit_if_toxic: list[float] = field(default_factory=list)
    hit_if_clean: list[float] = field(default_factory=list)
    discount: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    @property
    def n_voters(self) -> int:
        return len(self.lexicon) + len(self.patterns)


class Voters:
    """Votes and classifier inputs of whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self.compiled = [PATTERNS[p] for p in model.patterns]
        self.whole: dict[str, int] = {}
        begins: dict[int, dict[str, int]] = {}
        ends: dict[int, dict[str, int]] = {}
        for f, i in model.lexicon.items():
            {"=": self.whole, "^": begins.setdefault(len(f) - 1, {}), "$": ends.setdefault(len(f) - 1, {})}[f[0]][f[1:]] = i
        self.begins, self.ends = ([(n, d) for n, d in x.items() if d] for x in (begins, ends))

    def hits(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """Which voters fire; hits of lexicon entries in all; number of words."""
        out = np.zeros(self.model.n_voters, dtype=np.int8)
        each = np.zeros(len(self.model.lexicon), dtype=np.int64)
        words = _WORD.findall((text or "").lower())
        counts = Counter(words)
        for w in counts.keys() & self.whole.keys():
            each[self.whole[w]] += counts[w]
        for n, entries in self.begins:
            for w, k in counts.items():
                if (i := entries.get(w[:n])) is not None and len(w) > n:
                    each[i] += k
        for n, entries in self.ends:
            for w, k in counts.items():
                if (i := entries.get(w[-n:])) is not None and len(w) > n:
                    each[i] += k
        out[: len(each)] = each > 0
        for i, p in enumerate(self.compiled, len(each)):
            if text and p.search(text):
                out[i] = 1
        return out, int(each.sum()), len(words)

    @staticmethod
    def inputs(votes: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        rate = total / np.maximum(words, 1)
        return np.column_stack([votes, np.minimum(total, 8) / 4.0, np.minimum(rate * 20, 2.0)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        got = [self.hits(t) for t in texts]
        x = self.inputs(np.array([g[0] for g in got], dtype=float).reshape(len(got), -1), np.array([g[1] for g in got], dtype=float), np.array([g[2] for g in got], dtype=float))
        z = x @ np.array(self.model.weights) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, start: np.ndarray, truth: np.ndarray, strength: float = 0.25, rounds: int = 25, tie: float = 0.3) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """EM for a latent class with voters of unknown accuracy that may be correlated.

    ``votes`` (rows, voters) are 1, or 0 for abstaining; that no voter fires at all is a voter
    of its own. ``start`` is the first posterior. A voter that never meets another can't be
    judged by agreement, so the labels ``truth`` of the rows count for ``strength`` rows each
    as prior of class balance and rates. Given the posterior, each voter's rate in
    either class is estimated (with a small prior; voters fire for toxic, so never more in
    clean), and correlations of voters within the classes; one that is correlated with others
    at rho >= ``tie`` counts 1 / (1 + sum of those rho) of a vote, so a group of copies weighs
    as one. Returns posterior, class prior, rates (toxic, clean), discounts, silence last.
    """
    votes = np.column_stack([votes, votes.sum(axis=1) == 0]).astype(float)
    n, m = votes.shape
    post = start.astype(float)
    prior, a, b, discount = 0.5, np.full(m, 0.5), np.full(m, 0.5), np.ones(m)
    truth = truth.astype(float)
    for _ in range(rounds):
        w = post + strength * truth
        v = (1 - post) + strength * (1 - truth)
        prior = (w.sum() + 1) / (w.sum() + v.sum() + 2)
        a = (w @ votes + 0.1) / (w.sum() + 1)
        b = (v @ votes + 0.01) / (v.sum() + 1)
        b[:-1] = np.minimum(a, b)[:-1]
        residual = votes - post[:, None] * a - (1 - post)[:, None] * b
        spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
        rho = (residual.T @ residual) / max(n, 1) / np.outer(spread, spread)
        np.fill_diagonal(rho, 0)
        discount = 1 / (1 + np.where(rho >= tie, rho, 0).sum(axis=1))
        z = math.log(prior / (1 - prior)) + votes @ (discount * np.log(np.clip(a, 1e-6, 1) / np.clip(b, 1e-6, 1)))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - post).max(initial=0) < 1e-4
        post = new
        if done:
            break
    return post, prior, a, b, discount


def distinct_voters(entries: list[str], votes: np.ndarray, most: int, overlap: float = 0.9) -> list[int]:
    """Entries, best first, without repetitions of a better one.

    An entry repeats another if nearly all hits of either lie within the other's, and it is a
    piece of it, or the reverse, or only a word ending. Two stems that tend to meet both stay;
    the label model discounts them.
    """
    votes = votes.astype(np.float32)
    hits, both = votes.sum(axis=0), votes.T @ votes
    kept: list[int] = []
    for i, e in enumerate(entries):
        repeats = any(both[i, j] >= overlap * min(hits[i], hits[j]) and (e[0] == "$" or e[1:] in entries[j] or entries[j][1:] in e) for j in kept)
        if len(kept) < most and hits[i] and not repeats:
            kept.append(i)
    return kept


def train_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by damped Newton steps; the bias is not penalised."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge * max(len(x), 1))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + penalty * w
        h = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for rows never learned from: crc32 of the id as text is divisible by ``folds`` (null ids are)."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_voters: int = 96, max_entries: int = 600, min_precision: float = 0.7) -> Model:
    """Fit voters, label model and classifier on at most ``max_labelled`` labelled rows outside the held-out fold.

    Those rows (lowest hashes of the id; of repeated labels the largest counts, of repeated ids
    the least text) are used four ways: their labels propose the lexicon, words and word pieces
    that are far commoner in toxic texts (at most ``max_entries`` are tried and ``max_voters``
    kept, which is the model's size); their votes are what the label model sees, with the labels
    as a prior worth a quarter row each; its posteriors are what the linear classifier learns;
    and the threshold is placed where their labels are met best. Ids, languages and sources are
    never inputs. Null labels and ids are left out, null texts have no words. Without usable
    labels the scorer has pattern voters only.
    """
    text_batches(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), id_col)
    sample = materialize(texts.groupBy(id_col).agg(F.min("__text").alias("__text"), F.max("__y").alias("__y")).select("__text", "__y"), "labelled")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["f", "bad", "good"])

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(_WORD.findall((t or "").lower())) for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[0 if y else 1] += 1
            if len(seen) > 400_000:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    n_bad, n_good = sample.agg(F.coalesce(F.sum(F.when(F.col("__y") > 0, 1)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("__y") > 0, 0).otherwise(1)), F.lit(0))).first()
    lexicon: dict[str, int] = {}
    if n_bad and n_good:
        tested = sample.mapInArrow(count, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        p, q = F.col("bad") / n_bad, F.col("good") / n_good
        least = max(5, math.ceil(0.02 * n_bad))  # more than copies of one text reach
        strong = tested.where((F.col("bad") >= least) & (F.col("bad") >= min_precision * (F.col("bad") + F.col("good"))) & (p > 4 * q))
        gain = F.col("bad") * F.log((F.col("bad") + 0.5) / n_bad / ((F.col("good") + 0.5) / n_good))
        lexicon = {r[0]: i for i, r in enumerate(strong.orderBy(gain.desc(), F.length("f").desc(), "f").limit(max_entries).select("f").collect())}
    proposed = Model(lexicon, list(PATTERNS))

    def votes_of(model: Model) -> pa.Table:
        """``(y, votes, total, words)``: at most ``max_labelled`` rows of fixed width."""

        @lean
        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voters = Voters(model)
            for batch in batches:
                got = [voters.hits(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([np.packbits(g[0]).tobytes() for g in got], pa.binary()), *(pa.array([g[i] for g in got], pa.int64()) for i in (1, 2))], names=["y", "votes", "total", "words"])

        return sample.mapInArrow(vote, "y int, votes binary, total long, words long").toArrow()

    def matrix(rows: pa.Table, voters: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(rows.column("votes").to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)[:, :voters]

    rows = votes_of(proposed)
    n = rows.num_rows
    if not n:
        model = Model({}, list(PATTERNS))
        model.weights, model.bias = [1.0] * model.n_voters + [0.0, 0.0], -1.5
        return model
    entries = list(lexicon)
    kept = distinct_voters(entries, matrix(rows, len(entries)), max_voters) if entries else []
    model = Model({entries[j]: i for i, j in enumerate(kept)}, list(PATTERNS))
    rows = votes_of(model)
    votes = matrix(rows, model.n_voters).astype(float)
    lexicon = model.lexicon
    lexical = votes[:, : len(lexicon)].any(axis=1)
    post, model.prior, a, b, discount = label_model(votes, np.where(lexical, 0.9, 0.05) if len(lexicon) else np.where(votes.any(axis=1), 0.5, 0.1), rows.column("y").to_numpy(zero_copy_only=False) > 0)
    model.hit_if_toxic, model.hit_if_clean, model.discount = a.tolist(), b.tolist(), discount.tolist()
    x = Voters.inputs(votes, rows.column("total").to_numpy().astype(float), rows.column("words").to_numpy().astype(float))
    w, bias = train_linear(x, post)
    # place the threshold where the labels of these rows are met best; the middle of the best gap
    y, z = rows.column("y").to_numpy(zero_copy_only=False).astype(float) > 0, x @ w + bias
    if y.any() and not y.all():
        order = np.argsort(-z, kind="stable")
        right = np.concatenate([[0], np.cumsum(np.where(y[order], 1, -1))])
        cut = np.concatenate([[z.max() + 1], (z[order][:-1] + z[order][1:]) / 2, [z.min() - 1]])
        valid = np.concatenate([[True], z[order][:-1] > z[order][1:], [True]])
        best = np.where(valid, right, -np.inf)
        near = np.flatnonzero(best == best.max())
        bias -= float(cut[near[np.abs(cut[near]).argmin()]])
    model.weights, model.bias = w.tolist(), bias
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: how likely the whole text is toxic (0 to 1). Null and empty texts score as texts without a hit.

    Rows are independent: repeated rows score alike, an empty table gives no rows; other columns stay.
    """
    text_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != out]
    if text_col not in keep:
        raise ValueError(f"{out} would replace the text")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(model)
        at = keep.index(text_col)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(voters.score(batch.column(at).to_pylist()), pa.float64())], names=[*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)
