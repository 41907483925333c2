"""Each stage of the pipeline on the smallest tables, against brute force on the stage's own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from quirelake.llm import pii, quality, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def bag(t, k=5):
    w = t.lower().split()
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def test_columns(outputs):
    assert all(df.columns == corpus_pipeline.COLUMNS for df in outputs[:-1])


def test_quality(spark, outputs):
    before, after = texts(outputs[0]), texts(outputs[1])
    model = quality.fit_on(outputs[0], spark.read.parquet(f"{SF}/labels.parquet"))
    from quirelake.llm.common import text_bytes

    import pyarrow as pa

    want = {i for i, t in before.items() if model.score(*text_bytes(pa.array([t])))[0] >= quality.THRESHOLD}
    assert set(after) == want and all(after[i] == before[i] for i in after)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.95 * len(good)


def test_near_duplicates(outputs):
    before, after = texts(outputs[1]), texts(outputs[2])
    sets = {i: set(bag(t)) for i, t in before.items()}
    up = {i: i for i in before}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(before)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert set(after) == {root(i) for i in ids}


def test_decontamination(spark, outputs):
    before, after = texts(outputs[2]), texts(outputs[3])
    items = [bag(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(t):
        g = bag(t)
        for own in items:
            shared = set(own) & set(g)
            for s in range(max(1, len(g) - len(own) + 1)) if shared else ():
                a, b = Counter(g[s : s + len(own)]), Counter(own)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    return True
        return False

    assert set(after) == {i for i, t in before.items() if not leaks(t)} and len(after) < len(before)


def test_personal_data(outputs):
    before, after = texts(outputs[3]), texts(outputs[4])
    assert set(after) == set(before)
    for i, t in before.items():
        base = pii.base_spans(t)
        assert after[i] == pii.masked(t, base + pii.added_spans([t], [base])[0]) and not pii.base_spans(after[i])
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[4].collect())


def test_packing(outputs):
    before = texts(outputs[4])
    enc = tokens.encoder(*tokens.default_paths())
    by = {}
    fill = Counter()
    for r in outputs[5].collect():
        by.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        fill[r["sequence_id"]] += r["length"]
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in by.items()} == {i: enc.encode(t) + b"\1\0\0\0" for i, t in before.items()}
    assert max(fill.values()) <= 2048 and sum(fill.values()) >= 0.9 * 2048 * len(fill)
    assert np.array(list(fill.values())).min() > 0


def test_run(spark, outputs):
    assert corpus_pipeline.run(spark, SF).count() == outputs[5].count()


BASE = "the quick brown fox jumps over the lazy dog and then it runs home to sleep by the fire until the sun comes up again"
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, BASE), (4, BASE), (4, BASE), (5, BASE.upper()), (6, BASE + " now"), (7, "call +49 30 1234567 or a.b@c.example.org"), (7, "x"), (8, "long " * 60_000), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, len(t) if t else None, "kept", 9) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__row` string, `__bucket` int").repartition(3)


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept.append(sorted(str(r["doc_id"]) for r in docs.collect()))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kept[0].count("4") == 2 and kept[1].count("4") == 1  # of equal rows one stays
    assert {"5", "6"}.isdisjoint(kept[1]) and kept[1].count("7") == kept[0].count("7")
    assert len([i for i in kept[1] if i in ("1", "2", "3", "None")]) <= 1  # texts without words are copies
    assert set(kept[4]) == set(kept[3])  # every document has its end token at least


@pytest.mark.parametrize("k", range(1, 5))
def test_stages_after_the_first_on_odd_rows(spark, odd, k):
    got = corpus_pipeline.STAGES[k][1](spark, odd, SF).collect()
    ids = Counter(r["doc_id"] for r in got)
    if k == 1:
        assert ids == Counter({1: 1, 4: 1, 7: 2, 8: 1})
    elif k == 2:
        assert ids == Counter(i for i, _ in ODD)
    elif k == 3:
        said = {(r["doc_id"], r["text"]) for r in got}
        assert (7, "call [PHONE] or [EMAIL]") in said and (1, None) in said and len(got) == len(ODD)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    else:
        assert set(ids) == {i for i, _ in ODD} and sum(r["length"] for r in got if r["start"] == 0 and r["length"] == 1) >= 3


@pytest.mark.parametrize("k", range(5))
def test_empty_tables_pass_every_stage(spark, odd, k):
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), SF).count() == 0
