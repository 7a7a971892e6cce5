"""The toxicity network: its derivatives, its inputs and windows against plain versions, held-out accuracy, odd tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmill.llm import toxicity as t

SCHEMA = "doc_id long, text string, score double, held_out string, toxic int"


def test_gradients_equal_differences():
    draw = np.random.default_rng(1)
    network = t.Network.new()
    network.weights = {k: w.astype(float) for k, w in network.weights.items()}
    x, real = draw.normal(size=(6, 5, t.INPUTS)), np.ones((6, 5))
    real[4:, 0] = real[1:, 1] = real[:, 2] = 0
    error = draw.normal(size=5)
    kept = {}
    network.logits(x, real, kept)
    found = network.gradients(x, real, error, kept)
    for name, weight in network.weights.items():
        for at in {tuple(draw.integers(0, n) for n in weight.shape) for _ in range(6)}:
            was, step, values = weight[at], 1e-3, []
            for move in (step, -step):
                weight[at] = was + move
                values.append(network.logits(x, real) @ error)
            weight[at] = was
            # states are single precision
            assert found[name][at] == pytest.approx((values[0] - values[1]) / (2 * step), rel=2e-2, abs=2e-3)


def test_padding_changes_nothing():
    network, draw = t.Network.new(), np.random.default_rng(2)
    x, real = draw.normal(size=(4, 3, t.INPUTS)).astype(np.float32), np.ones((4, 3), np.float32)
    longer = np.concatenate([x, draw.normal(size=(3, 3, t.INPUTS)).astype(np.float32)])
    mask = np.concatenate([real, np.zeros((3, 3), np.float32)])
    assert np.allclose(network.logits(x, real), network.logits(longer, mask), atol=1e-5)


def test_slots_do_not_depend_on_neighbours():
    found = ["a", "trash", "réeux", "ab", "x" * 300, "trash"]
    whole, grams = t._slots(found)
    start = 0
    for i, word in enumerate(found):
        alone, own = t._slots([word])
        assert alone[0] == whole[i]
        for (at, inside), (at_alone, inside_alone) in zip(grams, own):
            here = slice(start, start + len(word) + 2)
            assert (inside[here] == inside_alone).all() and (at[here][inside_alone] == at_alone[inside_alone]).all()
        start += len(word) + 2
    assert whole[1] == whole[5] and len(set(whole.tolist())) == 5


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 96, 97, 500])
def test_windows_overlap_and_cover_all(size):
    windows = t._windows(np.arange(1, size + 1, dtype=np.int32))
    assert sorted(set(windows.ravel().tolist()) - {t.PAD}) == list(range(1, size + 1))
    assert [w[0] for w in windows.tolist()][1:] == list(range(33, 33 + 32 * (len(windows) - 1), 32))


def model():
    draw = np.random.default_rng(3)
    evidence = t.Evidence(*draw.normal(size=(2, t.SLOTS)).astype(np.float32))
    return t.Model(evidence, t.Network.new())


def test_scores_equal_plain_version(monkeypatch):
    draw = np.random.default_rng(4)
    texts = ["", "  1 2", "one", *(" ".join(f"w{'abcdef'[i]}{'xyz'[j]}" for i, j in draw.integers(0, 3, (n, 2))) for n in (5, 64, 65, 400, 3000))]
    m = model()

    def plain(text):
        found = [w for block in t.words(text) for w in block]
        values = m.evidence.inputs(found) if found else np.zeros((0, t.INPUTS), np.float32)
        best = -np.inf
        for start in range(0, max(1, len(found) - t.WINDOW + t.STRIDE), t.STRIDE):
            part = values[start : start + t.WINDOW]
            x = np.zeros((max(1, len(part)), 1, t.INPUTS), np.float32)
            x[: len(part), 0] = part
            best = max(best, m.network.logits(x, np.ones((len(x), 1)) * (len(part) > 0))[0])
        return 1 / (1 + np.exp(-best))

    want = [plain(text) for text in texts]
    assert np.allclose(t._Scorer(m).scores(texts), want, atol=1e-5)
    # long texts in blocks, few windows at a time, words forgotten
    for name, value in (("BLOCK", 40), ("TOGETHER", 3), ("REMEMBERED", 2)):
        monkeypatch.setattr(t, name, value)
    assert np.allclose(t._Scorer(m).scores(texts), want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = t.classify(docs, t.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    guess, truth = found["predicted"] == 1, found["toxic"] == 1
    assert (guess & truth).sum() >= 0.93 * truth.sum()
    assert (guess & ~truth).sum() <= 0.05 * (~truth).sum()


def test_odd_tables(spark):
    texts = [None, "", " 1 ", "idiot", "same", "same", "x" * 50_000, "many words " * 60_000]
    docs = spark.createDataFrame([(i if i != 4 else None, v, 9.0, "own", 7) for i, v in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (None, 1, 5), (3, 1, 5), (3, 0, 5), (5, 2, 5)], "doc_id long, toxic int, quality int")
    for given in (labels, labels.filter(F.lit(False))):
        got = t.classify(docs, t.train(docs, given)).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        by_text = {r.doc_id: r.score for r in got}
        assert by_text[0] == by_text[1] == by_text[2] and by_text[5] == by_text[None]
    assert t.classify(docs.filter(F.lit(False)), t.train(docs, labels)).count() == 0
