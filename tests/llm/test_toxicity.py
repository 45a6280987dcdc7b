import random
import zlib

import numpy as np

from pointspark.llm import toxicity as t


def corpus(n=500):
    rng = random.Random(11)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 150))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randint(1, 3)):
            stem = rng.choice(["vilgram", "dorkpot", "zubbish"])
            words[rng.randrange(len(words))] = stem + "".join(rng.choice("xyq") for _ in range(rng.randint(0, 3)))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_features_stay_inside_words():
    bucket, owner = t.word_features(["ab", "abc", "ab"])
    same = [set(bucket[owner == i].tolist()) for i in range(3)]
    assert same[0] == same[2] != same[1]
    alone = t.word_features(["abc"])[0]
    assert set(alone.tolist()) == same[1]
    assert bucket.max() < t.BUCKETS


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x, 9) for i, x, _ in rows] + [(900, None, 1), (901, " ", 1), (902, "ale vilgramqqy sol", 1), (None, "ale sol", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 0), (None, 1)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    found = {r.doc_id: r for r in t.score(docs, model).collect()}
    assert len(found) == len(rows) + 4
    out = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(p == y for p, y in out) / len(out) > 0.95
    assert found[902].predicted == 1
    assert found[900].score == found[901].score < 0.5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    assert [r.score for r in t.score(docs, model).collect()] == [0, 0]
    assert t.score(docs.limit(0), model).collect() == []


def test_scores_do_not_depend_on_batches():
    rows = corpus(120)
    model = t.train([x for _, x, _ in rows], np.array([y for _, _, y in rows]))
    texts = [x for _, x, _ in rows] + [None, "new wordzz"]
    whole = t.score_texts(model, texts, t._Words(model))
    memo = t._Words(model)
    single = np.concatenate([t.score_texts(model, [x], memo) for x in texts])
    assert np.allclose(whole, single)


def test_scores_equal_averaging_embedding_rows(monkeypatch):
    """Scores again from the trained table and softmax, window by window: rows of n-grams averaged, classes by softmax, the highest window by the fit."""
    held, of = [], np.random.default_rng

    class Kept(np.ndarray):
        def astype(self, kind):
            held.append(np.asarray(self).astype(kind))
            return held[-1]

    class Random:
        def __init__(self, seed):
            self.own = of(seed)

        def normal(self, *more):
            return self.own.normal(*more).view(Kept)

        def __getattr__(self, name):
            return getattr(self.own, name)

    rows = corpus(150)
    monkeypatch.setattr(t.np.random, "default_rng", Random)
    model = t.train([x for _, x, _ in rows], np.array([y for _, _, y in rows]))
    monkeypatch.undo()
    table, soft = held
    assert table.shape == (t.BUCKETS, t.DIM) and soft.shape == (t.DIM, 2) and np.abs(table).max() > 0.6  # trained in place

    def logit(words):
        ids = np.concatenate([t.word_features([w])[0] for w in words])
        scores = table[ids].astype(float).mean(0) @ soft + np.array([0, model.bias])
        p = np.exp(scores - scores.max())
        p /= p.sum()
        return np.log(p[1] / p[0])

    texts = [x for _, x, _ in rows[:60]] + ["one", "vilgramx", "Dorkpotq ale", "é ß 日本 vilgrammm sol ant", "a b c d e f g"]
    want = []
    for text in texts:
        words = text.lower().split()
        best = max(logit(words[i : i + t.WINDOW]) for i in range(len(words)))
        want.append(1 / (1 + np.exp(-(model.a * best + model.b))))
    assert np.allclose(t.score_texts(model, texts, t._Words(model)), want, atol=1e-4)
