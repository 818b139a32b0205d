"""The pipeline stage by stage against plain Python on sf0.001, and whole."""

import os
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_toxic_documents_go(spark, stages):
    from runlens.llm import toxicity
    from runlens.llm.common import table

    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = toxicity.Voters(model).score([r.text for r in stages[0]])
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r, s in zip(stages[0], scores, strict=True) if s < 0.5}
    assert len(stages[1]) > 0.7 * len(stages[0])


def test_one_of_each_group_stays(stages):
    """Documents are linked at a Jaccard of 0.8 or more of their five-word shingles, by brute force."""

    def shingles(text, k=5):
        w = (text or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = {r.doc_id: shingles(r.text) for r in stages[1]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in stages[2]} == {find(i) for i in ids}


def test_later_passages_are_cut(stages):
    first = {}
    want = {}
    for r in sorted(stages[2], key=lambda r: r.doc_id):
        data = r.text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 199):
            if first.setdefault(data[i : i + 200], (r.doc_id, i)) != (r.doc_id, i):
                gone[i : i + 200] = True
        want[r.doc_id] = data, gone
    for r in stages[3]:
        data, gone = want.pop(r.doc_id)
        assert r.n_chars == len(r.text) or not gone.any()
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        # cuts keep to whole characters, so at most their parts at the ends of a cut differ
        assert len(r.text) - len(kept) in range(0, 2 * int(np.abs(np.diff(gone.astype(int))).sum()) + 1)
    assert all(g.all() or not bytes(np.frombuffer(d, np.uint8)[~g]).strip() for d, g in want.values())


def test_benchmark_goes_and_nothing_else(spark, stages):
    from runlens.llm import decontam

    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r.doc_id for r in stages[3] if any(decontam.myers(t, decontam.normal(r.text), int(len(t) * 0.05)) for t in items)}
    assert hit and {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]} - hit


def test_packed_tokens(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = {}
    for r in sorted(stages[5], key=lambda r: (r.doc_id, r.start)):
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert {i: zlib.crc32(np.array(x).tobytes()) for i, x in whole.items()} == {r.doc_id: zlib.crc32(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]).tobytes()) for r in stages[4]}


def test_run(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start)
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[5]))


def unlike(rng, n=60):
    return " ".join(f"u{rng.getrandbits(40):x}" for _ in range(n))


def test_null_and_repeated_ids(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(4)
    texts = [unlike(rng) for _ in range(9)]
    passage, item = unlike(rng, 40), unlike(rng, 20)
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, None), (None, ""), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, f"{texts[4]} {passage} {texts[5]}"), (7, f"{texts[6]} {passage} {texts[7]}"), (8, f"{texts[8]} {item}")]
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append([(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else docs.collect())
    assert len(kept[0]) == len(rows)
    assert sorted(t or "" for _, t in kept[1]) == sorted(["", *texts[:4], *(t for _, t in rows[8:])])
    after = {i: t for i, t in kept[2] if i in (6, 7)}
    assert len(kept[2]) == len(kept[1]) and after[6] == rows[8][1] and passage not in after[7] and texts[6] in after[7]
    assert len(kept[3]) == len(kept[2]) - 1 and 8 not in {i for i, _ in kept[3]}
    assert len({(r.sequence_id, r.offset) for r in kept[4]}) == len(kept[4]) >= len(kept[3])


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
