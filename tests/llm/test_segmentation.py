import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pointspark.llm import segmentation as s

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattices():
    return s.Lattices(MODEL)


def paths(lat, text):
    """All segmentations: ids -> probability, by walking the lattice."""
    out = [((), 0.0)]
    for word in s.words_of(text):
        node = int(lat.nodes([word])[0])
        done, open_ = [], [((), 0.0, node)]
        while open_:
            edges, p, n = open_.pop()
            for e in range(*lat.edges_of(n)):
                t = int(lat.target[e])
                (done.append(((*edges, e), p + lat.logp[e])) if t < 0 else open_.append(((*edges, e), p + lat.logp[e], t)))
        out = [(a + b, p + q) for a, p in out for b, q in done]
    return {a: math.exp(p) for a, p in out}


@pytest.mark.parametrize("text", ["ab", "the cat", "x  y ", " é漢😀", "\n\tcode"])
def test_probabilities_are_products_of_weights(lattices, text):
    found = paths(lattices, text)
    assert math.isclose(sum(found.values()), 1, rel_tol=1e-9)
    for edges in found:
        assert lattices.decode(lattices.ids(np.array(edges)).tolist()) == text
    assert len({tuple(lattices.ids(np.array(e)).tolist()) for e in found}) == len(found)


def test_samples_are_distinct_and_follow_the_lattice(lattices):
    text, n, k = "thes be", 6000, 3
    want = paths(lattices, text)
    found = s.sample(lattices, [text] * n, [7919 * i + 1 for i in range(n)], k)
    first, included, weight = Counter(), Counter(), Counter()
    for samples in found:
        keys = [tuple(e.tolist()) for e, *_ in samples]
        assert len(set(keys)) == k
        assert [g for _, _, g, _ in samples] == sorted((g for _, _, g, _ in samples), reverse=True)
        first[keys[0]] += 1
        for key, (_, p, _, q) in zip(keys, samples, strict=True):
            assert math.isclose(p, math.log(want[key]), abs_tol=1e-6)
            assert 0 < q <= 1
            included[key] += 1
            weight[key] += want[key] / q
    for key, p in want.items():
        assert abs(first[key] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    # Without replacement: order of draws as in successive sampling.
    likely = sorted(want, key=want.get)[-2:]
    second = sum(want[a] * want[likely[1]] / (1 - want[a]) for a in want if a != likely[1])
    got = sum(tuple(x[1][0].tolist()) == likely[1] for x in found) / n
    assert abs(got - second) < 4 * math.sqrt(second * (1 - second) / n) + 1e-3
    # Probability over inclusion is an unbiased weight.
    for key in likely:
        assert abs(weight[key] / n - want[key]) < 0.05


def test_few_segmentations_and_joint_nodes(lattices, monkeypatch):
    (only,) = s.sample(lattices, ["a"], [5], 10)
    assert len(only) == len(paths(lattices, "a")) and all(q == 1 for *_, q in only)
    monkeypatch.setattr(s, "WINDOW", 0.5)
    want = paths(lattices, "thes be")
    found = s.sample(lattices, ["thes be"] * 3000, list(range(3000)), 3)
    first = Counter(tuple(x[0][0].tolist()) for x in found)
    second = Counter(tuple(x[1][0].tolist()) for x in found)
    top = max(want, key=want.get)
    assert abs(first[top] / 3000 - want[top]) < 0.04
    expected = sum(want[a] * want[top] / (1 - want[a]) for a in want if a != top)
    assert abs(second[top] / 3000 - expected) < 0.04
    assert all(len({tuple(e.tolist()) for e, *_ in x}) == 3 for x in found)


def test_rows(spark):
    texts = [None, "", " ", "a", "Some words, and more.\nÉté 漢字 😀", "word " * 3000 + "end", "x" * 5000, "  two  spaces  ", "same text", "same text"]
    docs = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(texts)] + [(9, "same text", "k")], "doc_id long, text string, key string")
    rows = s.decode_ids(s.sample_encodings(docs, MODEL), MODEL).collect()
    for r in rows:
        assert r.decoded == (texts[r.doc_id or 0] or "")
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.rank), set()).add((tuple(r.ids), r.log_prob))
    assert all(len(x) == 1 for x in by.values())
    assert len({next(iter(by[5, r]))[0] for r in range(1, s.K + 1)}) == s.K
    assert by[8, 1] != by[9, 1] or by[8, 2] != by[9, 2]
    assert by[None, 1] == {((), 0.0)}
    short = s.encode_and_decode(docs.repartition(5), MODEL).collect()
    assert sorted((r.doc_id or 0, r.rank, r.ids_crc32) for r in short) == sorted((r.doc_id or 0, r.rank, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)
    assert all(r.decoded for r in short)
    assert s.encode_and_decode(docs.limit(0), MODEL).collect() == []


def test_searches_of_a_block_open_their_paths_together(lattices, monkeypatch):
    texts = ["a", "", "thes be", "Some words, and more.\nÉté 漢字 😀", "word " * 300 + "end", "x" * 200] * 20
    keys = [7919 * i + 1 for i in range(len(texts))]
    calls = []
    monkeypatch.setattr(s, "open_paths", lambda *x, f=s.open_paths: calls.append(len(x[1])) or f(*x))
    together = s.sample(lattices, texts, keys, 3)
    assert len(calls) == 3 and calls[0] == 100
    paths = lambda found: [(p, g, q, lattices.ids(e).tolist()) for e, p, g, q in found]
    for text, key, found in zip(texts, keys, together, strict=True):
        assert paths(s.sample(lattices, [text], [key], 3)[0]) == paths(found)
