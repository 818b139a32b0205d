"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from runlens.llm import blocks, chat, common, decontam, embeddings, graph, htmltext, packing, sharding, simhash, suffix, toxicity, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, fp string, text_crc32 string, n_removed string, score string, marks string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".", "é"]) for _ in range(n))


@functools.cache
def texts():
    """Plain, copied, near-copied, overlapping, empty, null, short and long texts."""
    rng = random.Random(7)
    passage = words(rng, 90)
    base = [words(rng, rng.randrange(20, 300)) for _ in range(20)]
    out = [*base, None, "", "  \n", "a", "a b", "Ünïcödé ß É " * 30, "x" * 700, words(rng, 12_000), base[0], base[0], base[1] + " tail", "head " + base[1]]
    for i in range(5):
        t = base[2].split()
        t[rng.randrange(len(t))] = f"changed{i}"
        out.append(" ".join(t))
    out += [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(4)] + [passage]
    return out


def documents(spark, rows=None):
    rows = [(i, t) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame([(i, t, "hot", "x", "y", "z", "s", "m") for i, t in rows], DOCS).repartition(3)


def repeated():
    """Rows of which one is given twice, and one has no id."""
    return [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3]), (None, "no id at all"), (None, None)]


# -- packing -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seq_len", [64, 2048])
def test_packing_keeps_every_id(spark, seq_len):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate([*texts(), "don't stop", "<|endoftext|> x<|startoftext|>", "İstanbul ǅ e\u0301 A\u030a 12 3,4 %%% a'b", "tab\tand\x0bvt\x85nel\u3000wide"])]
    got = packing.pack(documents(spark, rows), VOCABULARY, seq_len=seq_len, chunk_tokens=5000).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id][r.start] = (ids, r.doc_tokens)
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for i, t in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = pieces[i]
        assert [x for s in sorted(own) for x in own[s][0]] == want and {p[1] for p in own.values()} == {len(want)}
    for s in sequences.values():
        end = 0
        for offset, n, size in sorted(s):
            assert offset == end
            end += n
        assert end == size <= seq_len and (end == seq_len or end & (end - 1) == 0)


def test_word_encoder_forgets_and_slices(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_WORDS_AT_ONCE", 7)
    tokenizer, encode = Tokenizer.from_file(VOCABULARY), packing.WordEncoder(VOCABULARY, remember=150)
    for turn in range(2):
        for t in [*texts(), "zzz yyy, \u3000 Ünï"]:
            ids, ends = encode(pa.array([t, None, t]), 1)
            want = tokenizer.encode(t or "", add_special_tokens=False).ids
            assert ids.tolist() == [*want, 1, 1, *want, 1]
            assert ends.tolist() == [len(want) + 1, len(want) + 2, 2 * len(want) + 3]
        encode.rest()
    encode.rest()
    assert not encode.known and not len(encode.pool)


def test_other_vocabularies_encode_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, tokenizer = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert not encode.by_words and packing.WordEncoder(VOCABULARY).by_words
    some = ["Two  words\n and more", "", None, " lead"]
    ids, ends = encode(pa.array(some), 7)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in some]
    assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    encode.rest()


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 4000)
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.pack_lengths(lengths, 2048, 1.0, 1 / 2048):
        cost[s] += n + n * n / 2048
    full = [c for s, c in cost.items() if c > 2048]
    assert np.std(full) / np.mean(full) < 0.1


@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64]))
@settings(max_examples=150, deadline=None)
def test_packing_assignment_by_hand(lengths, seq_len):
    got = packing.pack_lengths(np.array(lengths, dtype=np.int64), seq_len, 1.0, 1 / seq_len)
    want, rest = [], []
    for d, n in enumerate(lengths):
        for k in range(n // seq_len):
            want.append((d, k * seq_len, seq_len, len(want), 0))
        if n % seq_len:
            rest.append([d, n // seq_len * seq_len, n % seq_len])
    first, total = len(want), sum(r[2] for r in rest)
    open_ = [{"size": seq_len, "used": 0, "cost": 0.0} for _ in range(total // seq_len)] + [{"size": 2**b, "used": 0, "cost": 0.0} for b in range(20, -1, -1) if total % seq_len >> b & 1]
    for d, at, n in sorted(rest, key=lambda r: (-r[2], r[0])):  # descending, each to the cheapest sequence with room
        while n:
            room = [(s["cost"], i) for i, s in enumerate(open_) if s["size"] - s["used"] >= n]
            i = min(room)[1] if room else max(range(len(open_)), key=lambda i: (open_[i]["size"] - open_[i]["used"], -i))
            s = open_[i]
            take = min(n, s["size"] - s["used"])
            want.append((d, at, take, first + i, s["used"]))
            s["used"], s["cost"] = s["used"] + take, s["cost"] + take + take * take / seq_len
            at, n = at + take, n - take
    assert sorted(map(tuple, got)) == sorted(want) and all(s["used"] == s["size"] for s in open_)


def test_packing_nothing(spark):
    assert packing.pack(documents(spark, []), VOCABULARY).count() == 0


# -- toxicity ----------------------------------------------------------------------------------


def test_toxicity_learns_held_out_words(spark):
    rng = random.Random(3)
    bad = ["grumblefool", "zorkhead", "vilewretch"]
    rows, labels = [], []
    for i in range(900):
        t, toxic = words(rng, 40), i % 6 == 0
        if toxic:
            t += " " + " ".join(rng.choice(bad) + rng.choice(["", "s", "y"]) for _ in range(3))
        rows.append((i, t))
        labels.append((i, int(toxic), "clash"))
    docs = documents(spark, [*rows, (5000, None), (5001, "")])
    lab = spark.createDataFrame([*labels, (None, 1, ""), (7, None, ""), (0, 1, "")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, lab)
    got = toxicity.score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    score = {r.doc_id: r.score for r in got.collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((score[i] >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert score[5000] == score[5001] < 0.5
    assert {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()} == {i for i in [*range(900), 5000, 5001] if zlib.crc32(str(i).encode()) % 5 == 0}


def test_labelled_rows_are_bounded(spark, monkeypatch):
    sent = []
    real = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda votes, *a, **k: sent.append(len(votes)) or real(votes, *a, **k))
    docs = documents(spark, [(i % 40, f"text number {i} bad" if i % 3 else None) for i in range(4000)])
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_labelled=10)
    assert sent == [10] and toxicity.score(docs, model).count() == 4000


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark), none)
    assert all(0 <= r.score <= 1 for r in toxicity.score(documents(spark), model).collect())
    assert toxicity.score(documents(spark, []), model).count() == 0


@given(st.lists(st.sampled_from(["badword", "badly", "abad", "BADWORD", "good", "x", "unbadword", "sobad", ",", "!!!!", "shut up"]), max_size=40))
@settings(max_examples=200, deadline=None)
def test_votes_by_hand(parts):
    text = " ".join(parts)
    entries = ["=badword", "^badw", "$word", "=x", "$sobad", "^sob"]
    voters = toxicity.Voters(toxicity.Model({e: i for i, e in enumerate(entries)}, list(toxicity.PATTERNS)))
    found = [w for w in text.lower().replace(",", " ").replace("!", " ").split()]
    fits = {"=": lambda w, e: w == e, "^": lambda w, e: w.startswith(e) and w != e, "$": lambda w, e: w.endswith(e) and w != e}
    each = [sum(fits[e[0]](w, e[1:]) for w in found) for e in entries]
    votes, total, n = voters.hits(text)
    assert votes[: len(entries)].tolist() == [int(k > 0) for k in each] and total == sum(each) and n == len(found)
    assert votes[len(entries) :].tolist() == [int(bool(p.search(text))) for p in toxicity.PATTERNS.values()]


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    voter = lambda a, b: (rng.random(4000) < np.where(y, a, b)).astype(float)
    first = voter(0.6, 0.05)
    votes = np.column_stack([first, first, first, voter(0.5, 0.02), voter(0.4, 0.02)])
    post, prior, a, b, discount = toxicity.label_model(votes, votes.any(axis=1) * 0.8, y)
    assert discount[0] < 0.5 < discount[3] and abs(prior - 0.3) < 0.1 and (a[:5] > b[:5]).all()
    assert ((post > 0.5) == y).mean() > 0.8


# -- decontamination ---------------------------------------------------------------------------


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row, old = [i], row
        for j, t in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (p != t)))
    return min(row), row.index(min(row))


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=100), st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_myers(pattern, text, limit):
    d, end = distance(pattern, text)
    assert decontam.myers(pattern, text, limit) == ((d, end) if d <= limit and end else None) or (d <= limit and not end)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, words(rng, 30)) for i in range(12)] + [(20, None), (21, ""), (22, "short"), (3, None)]
    near = lambda t, n: functools.reduce(lambda s, k: s[:k] + "#" + s[k + 1 :], [7 + 11 * i for i in range(n)], t)
    rows = [(i, words(rng, 200)) for i in range(10)] + [(100 + i, words(rng, 300) + "\n " + near(items[i][1], n).upper() + " " + words(rng, 5)) for i, n in enumerate((0, 1, 3, 5))] + [(200, None), (201, "")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for chunk in (4_000_000, 300):
        got = {(r.doc_id, r.item_id): r for r in decontam.matches(docs, bench, chunk_chars=chunk).collect()}
        want = {}
        for d, t in rows:
            for i, u in items:
                t2, u2 = decontam.normal(t), decontam.normal(u)
                if len(u2) >= 20 and (e := distance(u2, t2))[0] <= int(len(u2) * 0.05):
                    want[d, i] = e[0]
        assert {k: r.distance for k, r in got.items()} == want and len(want) == 4
        for (d, i), r in got.items():
            assert distance(decontam.normal(dict(items)[i] if i != 3 else items[3][1]), decontam.normal(dict(rows)[d])[r.start : r.end])[0] == r.distance
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(10), 200, 201}
    assert decontam.matches(docs, bench.limit(0)).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_with_clashing_names_and_many_chunks(spark):
    rng = random.Random(15)
    items = [(i, words(rng, 20)) for i in range(6)]
    rows = [(i, words(rng, 2_000 if i == 4 else 30) + " " + items[i % 6][1] * (i % 2)) for i in range(8)] + [(None, items[0][1]), (None, None), (3, "copy")]
    docs = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "item_id long, text string, __leak boolean, __row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (2_000_000, 100):
        got = decontam.matches(docs, bench, id_col="item_id", chunk_chars=chunk)
        assert got.columns == ["item_id", "benchmark_item_id", "distance", "start", "end"]
        assert sorted((str(r.item_id), r.benchmark_item_id) for r in got.collect()) == [("1", 1), ("3", 3), ("5", 5), ("7", 1), ("None", 0)]
        kept = decontam.decontaminate(docs, bench, chunk_chars=chunk)
        assert kept.columns == docs.columns and sorted((str(r.item_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in [*rows[0:8:2], rows[9], rows[10]])


def test_short_items_match_as_whole_words(spark):
    docs = documents(spark, [(1, "Say  Short, please"), (2, "a shorter one"), (3, "unshort"), (4, "shot"), (5, None), (6, "2+2=4"), (7, "12+2=4")])
    bench = spark.createDataFrame([(1, "short"), (2, ""), (3, None), (4, " 2+2 ")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.matches(docs, bench).collect())
    assert got == [(1, 1, 0, 4, 9), (6, 4, 0, 0, 3)]
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {2, 3, 4, 5, 7}


# -- SimHash -----------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [3, 1024])
def test_simhash_finds_every_link(spark, block):
    rows = [(i, t) for i, t in enumerate(texts())]
    fps = {i: plain_fingerprint(t, 3) for i, t in rows}
    roots = reach(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    got = simhash.near_duplicates(documents(spark, [*rows, rows[3]]), shingle=3, words=1, distance=3, chain=None, distinct=False, block=block).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert int.from_bytes(r.fp, "big") == fps[r.doc_id] and r.component_id == roots[r.doc_id]


@pytest.mark.parametrize(("block", "share", "short"), [(16, 1000, 1 << 26), (16, 5, 0), (1024, 1000, 0)])
def test_pigeonring_misses_nothing(spark, monkeypatch, block, share, short):
    monkeypatch.setattr(blocks, "SHARE", share)
    monkeypatch.setattr(simhash, "_SHORT", short)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for n in (1, 2, 3, 4):
            fps.add(functools.reduce(lambda x, b: x ^ 1 << b, rng.sample(range(64), n), f))
    fps |= {1 << a | 1 << b for a in range(3) for b in range(20, 40)}  # one hot group
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(signed[f], bytearray(f.to_bytes(8, "big"))) for f in fps], "node long, fp binary")
    edges = [(r.src, r.dst) for r in simhash.links(frame, 1, 3, None, block, len(fps)).collect()]
    every = sorted(fps)
    want = reach(signed.values(), [(signed[a], signed[b]) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= 3])
    assert reach(signed.values(), edges) == want


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = documents(spark, repeated())
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert len(ids) == len(set(ids)) and 0 in ids and 2 in ids and 3 in ids
    base = len([t for t in texts() if t])
    assert not {28, 29} & set(ids) and sum(32 <= i <= 36 for i in ids) == 0 and len(ids) < base
    assert simhash.deduplicate(documents(spark, [])).count() == 0


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_near_duplicates_link_exactly_by_jaccard(spark):
    rng = random.Random(31)
    rows = []
    for n in (12, 30, 105, 305):
        for wanted in (0.70, 0.73, 0.76, 0.79, 0.80, 0.81, 0.82, 0.83, 0.85):
            for _ in range(8):
                base = [f"u{rng.getrandbits(40)}" for _ in range(n)]
                cut = round((1 - wanted) / (1 + wanted) * (n - 4))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[cut:] + [f"v{rng.getrandbits(40)}" for _ in range(cut)]))]
    sets = {i: shingle_set(t) for i, t in rows}
    jaccard = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)}
    assert sum(0.8 <= j <= 0.85 for j in jaccard.values()) > 50 and sum(0.7 <= j < 0.8 for j in jaccard.values()) > 50
    for block in (16, 1024):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), block=block).collect()}
        assert {i for i in jaccard if got[i] == got[i + 1]} == {i for i, j in jaccard.items() if j >= 0.8}
        assert all(got[i] in (i, i - i % 2) for i in got)


@pytest.mark.parametrize(("block", "share"), [(1024, 1000), (4, 3)])
def test_ring_finds_near_copies_without_bands_and_jaccard_decides(spark, monkeypatch, block, share):
    monkeypatch.setattr(blocks, "SHARE", share)
    monkeypatch.setattr(simhash, "candidates", lambda classes, *_: classes.selectExpr("node src", "node dst").limit(0))
    rng = random.Random(17)
    word = lambda: f"u{rng.getrandbits(40)}"
    rows = []
    for n, new, tries in ((104, 1, 6), (304, 6, 6), (2000, 1, 12), (54, 7, 1500)):  # new words at the end: the last ones are under 0.8
        base = [word() for _ in range(n)]
        made = [" ".join(base), *[" ".join(base[new:] + [word() for _ in range(new)]) for _ in range(tries)]]
        fp = [int.from_bytes(simhash.fingerprint(t, 5, 1, True), "big") for t in made]
        near = [t for t, f in zip(made, fp, strict=True) if (f ^ fp[0]).bit_count() <= 3 or tries < 100]
        rows += [(len(rows) + i, t) for i, t in enumerate(near)]
    sets, fps = {i: shingle_set(t) for i, t in rows}, {i: int.from_bytes(simhash.fingerprint(t, 5, 1, True), "big") for i, t in rows}
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert any(j < 0.8 for _, _, j in pairs) and any(fps[a] == fps[b] for a, b, j in pairs) and sum(j >= 0.8 for _, _, j in pairs) > 50
    want = reach(sets, [(a, b) for a, b, j in pairs if j >= 0.8])
    most = reach(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), block=block).collect()}
    assert all(got[i] == got[want[i]] for i in got) and all(most[got[i]] == most[i] for i in got)
    assert any(got[a] != got[b] for a, b, j in pairs if j < 0.8)
    assert {r.doc_id for r in simhash.deduplicate(documents(spark, rows), block=block).collect()} == set(got.values())


def test_deduplicate_keeps_unlike_documents_of_null_and_repeated_ids(spark):
    rng = random.Random(41)
    text = [" ".join(f"u{rng.getrandbits(40)}" for _ in range(60)) for _ in range(8)]
    near = text[0] + " tail"
    rows = [(1, text[0]), (None, near), (None, text[1]), (None, text[2]), (None, text[2]), (7, text[3]), (7, text[4]), (7, text[4] + " tail"), (9, text[5]), (None, text[5]), (None, text[6])]
    want = sorted([text[0], text[1], text[2], text[3], text[5], text[6]])
    for how in ({}, {"shingle": 3, "words": 1, "distance": 3, "chain": None, "distinct": False}):
        kept = [(r.doc_id, r.text) for r in simhash.deduplicate(documents(spark, rows), **how).collect()]
        fours = [t for _, t in kept if t.startswith(text[4])]
        if not how:
            assert len(fours) == 1 and sorted(t for _, t in kept if not t.startswith(text[4])) == want
            assert (1, text[0]) in kept and (9, text[5]) in kept
        assert set(text[1:4]) | {text[5], text[6]} <= {t for _, t in kept} and sum(t == text[2] for _, t in kept) == 1
    only = simhash.deduplicate(documents(spark, [(None, text[0]), (None, near), (3, text[0] + " end")])).collect()
    assert [(r.doc_id, r.text) for r in only] == [(3, text[0] + " end")]


def test_unfinished_components_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.components(path, max_rounds=2)


def test_components(spark):
    rng = random.Random(2)
    for links in ([], [(i, i + 1) for i in range(60)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 90)]):
        frame = spark.createDataFrame([*links, (5, 5), (None, 3)], "src long, dst long")
        got = {r.node: r.root for r in graph.components(frame).collect()}
        want = reach(range(400), links)
        assert all(got.get(n, n) == want[n] for n in range(400))


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    written = []

    def seen(df, tag, rows=None):
        out = common.materialize(df, tag, rows)
        written.append((tag, len(out.inputFiles())))
        return out

    monkeypatch.setattr(graph, "materialize", seen)
    links = [(i, i + 1) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graph.components(spark.createDataFrame(links, "src long, dst long"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.root for r in got.collect()} == {n: 0 for n in range(1, 301)}
    assert len(written) > 3 and all(files == 1 for _, files in written[1:])


def test_written_tables_have_a_file_for_each_share_of_their_rows(spark):
    frame = spark.range(0, 1000, 1, 8)
    for rows, files in ((None, 8), (0, 1), (1, 1), (common.FILE_ROWS, 1), (common.FILE_ROWS + 1, 2), (9 * common.FILE_ROWS, 8)):
        out = common.materialize(frame, "files", rows)
        assert len(out.inputFiles()) == files and out.agg(F.sum("id"), F.count("*")).first() == (499500, 1000)
        common.discard(out)


# -- sharding ----------------------------------------------------------------------------------


def test_sharding(spark):
    rows = [*repeated(), *[(1000 + i, f"t{i}") for i in range(4000)]]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    slots = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            data = (text[r.doc_id] or "").encode()
            assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 120 < sum(r.grown_shard == 16 for r in got) < 360 and max(map(len, slots.values())) < 1.5 * len(rows) / 16
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_draws_by_hand(spark):
    import math
    import struct

    def draw(key, level, weights):
        def score(node, weight):
            h = xxhash.xxh64_intdigest(struct.pack("<i", node), xxhash.xxh64_intdigest(level.encode(), xxhash.xxh64_intdigest(key.encode(), 42)))
            return -weight / math.log(((h >> 11) + 0.5) * 2.0**-53)

        return max(weights, key=lambda n: (score(n, weights[n]), -n))

    leaves = [sharding.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard % 3) for x in sharding.topology(16)]
    got = {r.id: r.shard for r in sharding.assign(spark.range(300), "id", leaves).collect()}
    for i, shard in got.items():
        key, below = str(i), leaves
        for level in ("region", "rack", "shard"):
            weights = defaultdict(float)
            for x in below:
                weights[getattr(x, level)] += x.weight
            node = draw(key, level, weights)
            below = [x for x in below if getattr(x, level) == node]
        assert below[0].shard == shard


def test_slots_of_rows_that_are_mostly_equal(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SHARE", 10)
    rows = [(7, "same")] * 300 + [(i, f"t{i}") for i in range(200)] + [(None, None)] * 90
    got = sharding.shard_documents(documents(spark, rows)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_movement_stays_in_the_changed_subtree(spark):
    keys = spark.range(4000).withColumn("shard", F.lit("clash"))
    old = sharding.topology(16)
    new = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in old]
    moved = sharding.assign(sharding.assign(keys, "id", old, "a"), "id", new, "b").where("a <> b").collect()
    assert moved and all(r.b // 4 == 1 for r in moved)  # region 1 holds shard 5
    assert all(r.b == 5 for r in moved if r.a // 2 == 2)  # within its rack rows go only to it


# -- embeddings --------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [20, 1024])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = []
    for c in np.linspace(0.95001, 0.999, 150):  # right above the threshold and on
        v = base[len(near)]
        o = rng.normal(size=32)
        o -= o @ v * v
        near.append((c * v + np.sqrt(1 - c * c) * o / np.linalg.norm(o)) * 3)
    group = base[7] + rng.normal(size=(60, 32)) * 0.02
    x = np.concatenate([base, near, group, base[9:10], base[9:10]]).astype(np.float32)
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0, 0.0], [2.0, 0.0]]
    rows += [(9000 + i, v, "l") for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string"), block=block).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    sim = y @ y.T
    np.fill_diagonal(sim, 0)
    want = (sim >= 0.95).sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert got[9000].n_links == 0 and all(got[9000 + i].n_links == 0 and got[9000 + i].kept for i in range(6))
    assert got[9006].n_links == got[9007].n_links == 1 and got[9007].component_id == 9006
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dim", [3, 16, 200])
def test_embedding_recall_by_dimension(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(500, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.normal(size=(500, dim))
    other -= (other * base).sum(axis=1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    c = np.linspace(0.9502, 0.99, 500)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other])
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id").n_links.to_numpy()
    sim = x @ x.T
    np.fill_diagonal(sim, 0)
    want = (sim >= 0.95).sum(axis=1)
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "_hash", lambda v: F.pmod(F.xxhash64(v), F.lit(3)))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 24)).astype(np.float32).tolist()
    rows = [*enumerate([*x, x[0], x[0], x[5]]), (77, [1.0, 2.0]), (78, [3.0]), (79, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: (2, 0) if i in (0, 40, 41) else (1, 5) if i in (5, 42) else (0, i) for i, _ in rows}


# -- chat --------------------------------------------------------------------------------------


def cheapest(roles):
    after = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    @functools.cache
    def go(i, last):
        if i == len(roles):
            return {3: 0, 2: 2}.get(last, 10**9)
        best = 10**9
        for new in (1, 2, 3):
            fix = 3 * (new != roles[i])
            if new in after[last]:
                best = min(best, fix + go(i + 1, new))
            if new == last:
                best = min(best, fix + 1 + go(i + 1, new))
            best = min([best, *(fix + 2 + go(i + 1, new) for extra in after[last] if new in after[extra])])
        return best

    return go(0, 0)


@pytest.mark.parametrize("block", [3, 1024])
def test_chat_repair(spark, block):
    rng = random.Random(8)
    names = ["user", "assistant", "system", "tool", None, " USER ", "human"]
    rows = [(c, t, rng.choice(names[: 2 + c % 6]), f"m{t}" if t % 5 else None, "z") for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x", "z"), (500, 1, "user", "tie", "z"), (500, 1, "user", "tie", "z"), (500, None, "system", "s", "z")]
    rows += [(600, t, rng.choice(["user", "assistant", "system"]), "long", "z") for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string").repartition(5)
    got = chat.repair(frame, block=block).collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    assert len(got) == len(rows)
    for turns in by.values():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        assert [r.turn is not None and r.turn for r in turns] == sorted((r.turn is not None and r.turn for r in turns))
        assert sum(r.cost for r in turns) == cheapest(tuple(chat.role_of(r.role) for r in turns))
        text = "".join(r.rendered for r in turns)
        said = [m.split("|>")[0] for m in text.split("<|") if m and not m.startswith("end")]
        assert said == (["system"] if said[0] == "system" else []) + ["user", "assistant"] * (len(said) // 2)
        assert text.count("<|end|>") == len(said)
    assert chat.repair(frame.limit(0)).count() == 0


# -- URL filters -------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [4096, 0])
def test_url_filter(spark, small):
    rng = random.Random(6)
    hosts = ["a.net", "net", "x.example.net", "example.net", "EXAMPLE.com", "b.example.com", "notnet", "q.org", "org", "a..net", "net:80"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/en/x?u=/de/", "/de/a/b#/fr/", "/fr/y", "?/en/", "#x")] + [None, "", "nothing", "://", "http:///en/", "a://b://c.net/"]
    rules = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("q.org", "/fr/y", "block"), ("", "", "block"), ("org", "/fr/", "block"), ("a.net", "/e", "allow"), ("b.example.com", "/de/a/b", "allow"), ("org", "", "allow"), ("net", None, "allow"), (None, "/x", "block")]
    urls += ["http://a.net/" + "x/" * 5000, "http://" + "s." * 3000 + "net/en/", "http://a.net/ads/x"]
    got = urlfilter.judge(spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, rule string"), spark.createDataFrame(rules, "host string, path string, verdict string"), small=small).collect()
    rules = [(a or "", b or "", v) for a, b, v in rules]
    assert len(got) == len(urls) + 1
    for r in got:
        rest = (r.url or "").partition("://")[2]
        host = rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])]
        path = rest[len(host) :]
        path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
        host = host.lower()
        fit = [(-len(a + b), a + b, v) for a, b, v in rules if a and (host == a.lower() or host.endswith("." + a.lower())) and path.startswith(b)]
        want = min(fit)[1:] if fit else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want), r


@pytest.mark.parametrize("small", [4096, 0])
def test_url_filter_with_many_rules_and_nothing(spark, monkeypatch, small):
    monkeypatch.setattr(blocks, "SHARE", 5)  # the most frequent URLs are hot
    rules = [(f"h{i}.com", f"/p{i % 7}", "block") for i in range(300)]
    urls = [(i, f"http://x.h{i % 50}.com/p{i % 7}/q", "c", "d", 1) for i in range(200)] + [(i, u, "c", "d", 1) for i, u in enumerate(["http://h1.com/p1"] * 90 + [None] * 90)]
    frame = spark.createDataFrame(urls, "page_id long, url string, __list string, __best string, __u int")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urlfilter.judge(frame, listed, small=small)
    assert got.columns == [*frame.columns, "host", "path", "rule", "verdict"]
    want = [((u or "").split("/")[2].split("x.")[-1] if u else "", u) for _, u, *_ in urls]
    fit = {(h, p) for h, p, _ in rules}
    assert sorted((r.url or "", r.verdict) for r in got.collect()) == sorted((u or "", "block" if any((h, p) in fit and u.split(h)[1].startswith(p) for p in {f"/p{k}" for k in range(7)}) else "allow") for h, u in want)
    assert {r.verdict for r in urlfilter.judge(frame, listed.limit(0), small=small).collect()} == {"allow"}
    assert urlfilter.judge(frame.limit(0), listed, small=small).count() == 0


# -- suffix dedup ------------------------------------------------------------------------------


def cut_bytes(all_texts, length):
    seen = defaultdict(int)
    data = [(t or "").encode() for t in all_texts]
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [i for i in range(len(b)) if gone[i] and not (i and gone[i - 1])]
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(gone), len(spans)))
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 32, 8192), (60, 16, 8192), (60, 16, 1)])
def test_repeats_exactly(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = repeated()
    want = cut_bytes([t for _, t in rows], length)
    got = suffix.remove_repeats(documents(spark, rows), length=length, gram=gram, keep="none").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept), r.n_removed, len(r.spans)) for r in got) == sorted((i is None, i or 0, *w) for (i, _), w in zip(rows, want, strict=True))


@pytest.mark.parametrize("share", [1000, 4])
def test_repeats_with_null_ids_and_hot_groups(spark, monkeypatch, share):
    monkeypatch.setattr(blocks, "SHARE", share)
    rng = random.Random(5)
    line, passage = words(rng, 60), words(rng, 70)
    rows = [(None, words(rng, 30) + passage[:250] + words(rng, 30)), (4, words(rng, 20) + passage + words(rng, 9)), (None, passage), (None, passage)]
    rows += [(10 + i, f"{words(rng, 30)} {line} {words(rng, 30)} {line}") for i in range(12)] + [(50 + i % 9, line + " copy") for i in range(20)]
    want = cut_bytes([t for _, t in rows], 200)
    got = suffix.remove_repeats(documents(spark, rows), keep="none").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept), r.n_removed, len(r.spans)) for r in got) == sorted((i is None, i or 0, *w) for (i, _), w in zip(rows, want, strict=True))


def test_repeats_with_text_ids_and_clashing_columns(spark):
    rng = random.Random(12)
    p = words(rng, 60)
    rows = [("a", f"{words(rng, 9)} {p}", 1), ("b", f"{p} {words(rng, 9)}", 2), (None, "", 3)]
    frame = spark.createDataFrame(rows, "t1 string, __text string, __row int")
    got = suffix.remove_repeats(frame, id_col="t1", text_col="__text", keep="none")
    assert got.columns == [*frame.columns, "kept", "n_bytes", "n_removed", "spans"]
    want = cut_bytes([t for _, t, _ in rows], 200)
    assert sorted((r["__row"], r.t1, bytes(r.kept), r.n_removed) for r in got.collect()) == sorted((k, i, w[0], w[1]) for (i, _, k), w in zip(rows, want, strict=True))


def test_long_text_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 1 << 12)
    monkeypatch.setattr(suffix, "_LOW", np.uint64((1 << 12) - 1))
    suffix._tables.cache_clear()
    rng = random.Random(1)
    data = np.frombuffer((words(rng, 3000, 50) + "ab" * 400).encode(), np.uint8)
    found = {}
    for begin, end, held in suffix._pieces(np.array([len(data)]), 200):
        for s, a, first, n, g, c in zip(*suffix.anchors_of(data[begin:end], np.array([h[1] - begin for h in held]), np.array([h[2] - begin for h in held]), 200, 32), strict=True):
            for w in range(first, first + n):
                assert begin + w not in found
                found[begin + w] = (a - w, g)
    suffix._tables.cache_clear()
    assert sorted(found) == list(range(len(data) - 199))
    by_text = {}
    for w, v in found.items():
        assert by_text.setdefault(data[w : w + 200].tobytes(), v) == v  # equal windows have one anchor


@pytest.mark.parametrize("hot", [8192, 1])
def test_first_copies_stay(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(11)
    p, q = "é".join(words(rng, 60).split(" ")), words(rng, 80)
    rows = [(1, words(rng, 30) + p + words(rng, 30)), (2, words(rng, 30) + p + "#" + q), (3, q + words(rng, 20)), (4, words(rng, 50)), (9, words(rng, 50) + " solo"), (5, p), (6, p), (7, None)]
    got = {r.doc_id: r for r in suffix.remove_repeats(documents(spark, rows), keep="first").collect()}
    assert all(got[i].n_removed == 0 for i in (1, 4, 9, 7))
    left = {i: bytes(r.kept).decode() for i, r in got.items()}
    assert p not in left[2] and q in left[2] and q not in left[3] and left[5] == left[6] == ""
    joined = b"\0".join((t or "").encode() for _, t in rows)
    kept = b"\0".join(bytes(r.kept) for r in got.values())
    assert all(any(w in k for k in (kept,)) for w in (p.encode(), q.encode())) and len(kept) < len(joined)


@given(st.binary(min_size=1, max_size=120), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_suffix_ranks(data, depth):
    rank = suffix.suffix_ranks(np.frombuffer(data, np.uint8), depth)
    tails = [data[i : i + depth] for i in range(len(data))]
    full = [i for i in range(len(data)) if len(tails[i]) == depth]
    assert all((rank[i] < rank[j]) == (tails[i] < tails[j]) and (rank[i] == rank[j]) == (tails[i] == tails[j]) for i in full for j in full)
    repeated_, later = suffix.window_matches(np.frombuffer(data, np.uint8), np.array(full, dtype=np.int64), np.array(full, dtype=np.int64), depth) if full else ([], [])
    for n, i in enumerate(full):
        assert later[n] == any(tails[j] == tails[i] for j in full if j < i)
        assert repeated_[n] == any(tails[j] == tails[i] for j in full if j != i)


@given(st.lists(st.sampled_from([0, 0, 0, 1, 200]), min_size=1, max_size=90), st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_longest_previous_factors(values, rng):
    data = bytes(values)
    n, depth = len(data), 20
    place = list(range(n))
    rng.shuffle(place)
    shared = lambda i, j: next((k for k in range(depth) if max(i, j) + k >= n or data[i + k] != data[j + k]), depth)
    order = sorted(range(n), key=lambda i: data[i : i + depth])
    lcp = suffix.common_prefixes(np.frombuffer(data, np.uint8), np.array(order[:-1], dtype=np.int64), np.array(order[1:], dtype=np.int64), depth)
    assert lcp.tolist() == [shared(i, j) for i, j in zip(order, order[1:], strict=False)]
    got = suffix.longest_previous_factors(np.array(order), np.concatenate([[0], lcp]), np.array(place))
    assert got.tolist() == [max((shared(i, j) for j in range(n) if place[j] < place[i]), default=0) for i in range(n)]


# -- HTML --------------------------------------------------------------------------------------

LONG = "Plain words of an article that go on for quite a while, long enough to count as text. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>x</script>", ""),
        ("<html><head><title>t</title></head><body><nav>menu</nav><header>top</header><article><h1>A &amp; B</h1><p>One<br>two<p><b>th</b>ree.</article><footer>f</footer>", "A & B One two three."),
        (f"<body><div class='sidebar'>{LONG}</div><div id=main-text><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div><form>{LONG}</form></body>", ("Head " + LONG * 2 + "Short. " + LONG).strip()),
        (f"<article><p>{LONG}</p><div class='ad'>buy</div><section id='comments'><article class='comment'>{LONG}nope</article></section><p>&#x41;&nbsp;\n b</p></article>", LONG + "A b"),
        ("<article><p>unclosed <i>tags <p>and </div> stray </article>", "unclosed tags and stray"),
    ],
)
def test_extracts_article(html, text):
    assert htmltext.extract_text(html) == text


@given(st.lists(st.floats(0, 500), min_size=1, max_size=30), st.sampled_from([0.5, 1.0, 2.0]))
@settings(max_examples=100, deadline=None)
def test_smoothing_by_hand(values, sigma):
    import math

    r = math.ceil(3 * sigma)
    weight = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)}
    want = [sum(w * values[min(max(i + d, 0), len(values) - 1)] for d, w in weight.items()) / sum(weight.values()) for i in range(len(values))]
    assert np.allclose(htmltext.smooth(np.array(values), sigma), want)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><article><h2>One</h2><p>{LONG * 5}</p></article><article><p>{LONG}</p><p>Two.</p></article><article><p>{LONG}</p></article></body>", f"One {LONG * 5}{LONG}Two. {LONG}"),
        (f"<body><article><p>A card. {LONG}</p></article><div id=text><h1>Head</h1><p>{LONG * 4}</p><p>Short.</p><p>{LONG * 4}</p></div></body>", f"Head {LONG * 4}Short. {LONG * 4}"),
        (f"<main><p>{LONG * 3}</p><p>Short.</p><article><p>{LONG}</p></article><p>{LONG * 3}</p></main>", f"{LONG * 3}Short. {LONG}{LONG * 3}"),
        (f"<div class='content-with-sidebar'><p>{LONG}</p><div class='social'>share</div><p>{LONG}</p></div>", LONG * 2),
        (f"<div class='sidebar'><article><p>{LONG}</p></article></div>", LONG),
        ("<article>" + "<div>" * 3000 + f"<p>{LONG}</p>", LONG),
    ],
)
def test_extracts_regions_of_the_page(html, text):
    assert htmltext.extract_text(html) == text.strip()


@pytest.mark.parametrize("html", ["<b>" * 100_000, "<div><i>" * 50_000, "</p>" * 100_000, "<article>" + "<p>" * 100_000, "<ul>" + "<li>" * 100_000, "<div>" * 5000 + LONG + "</div>" * 5000, "<b>" * 30_000 + "</i>" * 30_000, "<" * 20_000, "&" * 20_000])
def test_time_grows_with_length_alone(html):
    import time

    began = time.process_time()
    htmltext.extract_text(html)
    assert time.process_time() - began < 15


def test_extract_with_clashing_columns(spark):
    pages = spark.createDataFrame([("a", "<p>x</p>", "b")], "__html string, html string, _text string")
    assert [tuple(r) for r in htmltext.extract(pages).collect()] == [("a", "b", "x")]


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article>x</article>", "old"), (1, "u", "<article>x</article>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in htmltext.extract(pages).fillna("-").collect()) == [(1, "u", "x"), (1, "u", "x"), (2, "-", "")]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_digest_of_kept_bytes(spark):
    got = suffix.remove_repeats(documents(spark), keep="none").select("kept", F.sha2("kept", 256).alias("h")).first()
    assert got.h == hashlib.sha256(bytes(got.kept)).hexdigest()
