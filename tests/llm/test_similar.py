import random

import numpy as np

import corpus_pipeline
from pointspark.llm import simhash, similar
from pointspark.llm.decontaminate import shingle_strings, words


def jaccard(a, b):
    x, y = (shingle_strings(t, min(5, len(words(t)))) if words(t) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def fixture():
    rng = random.Random(4)
    sentence = lambda n: [f"w{rng.randrange(700)}" for _ in range(n)]
    texts = [None, "", " . ", "one two", "One, two!"]
    for _ in range(40):
        base = sentence(rng.randint(20, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                own[rng.randrange(len(own))] = "edit"
            texts.append(" ".join(own))
            base = rng.choice([base, own])
    return texts


def test_components_equal_brute_force(spark):
    texts = fixture()
    ids = [500 - i for i in range(len(texts))]
    label, far, pairs = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                pairs += 1
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.MAX_BITS
                label = [label[j] if x == label[i] else x for x in label]
    assert pairs > 60 and far > 10
    want = sorted((i, min(k for k, other in zip(ids, label, strict=True) if other == own)) for i, own in zip(ids, label, strict=True))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(docs, shingle=5, percent=80).collect())) == want
    assert similar.similar_duplicates(docs.limit(0)).collect() == []


def test_buckets_in_blocks_equal_brute_force(spark):
    """Members of one bucket that are similar in a chain: links by pairs of blocks."""
    rng = random.Random(6)
    sets = [np.unique(np.array([rng.randrange(1 << 60) for _ in range(40)], np.uint64))]
    for i in range(60):
        x = sets[i].copy() if rng.random() < 0.8 else np.array([rng.randrange(1 << 60) for _ in range(40)], np.uint64)
        x[rng.sample(range(len(x)), rng.randint(1, 5))] = rng.randrange(1 << 60)
        sets.append(np.unique(x))
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                label = [label[j] if x == label[i] else x for x in label]
    rest = spark.createDataFrame([(1, i, len(x)) for i, x in enumerate(sets)], "key long, set long, size long")
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "set long, hashes binary")
    for most in (10_000, 300):
        own = list(range(len(sets)))
        for r in similar.bucket_links(rest, table, 80, most).collect():
            own = [min(own[r.a], own[r.b]) if x in (own[r.a], own[r.b]) else x for x in own]
        assert own == label and len(set(label)) < len(label)


def test_pipeline_stage_drops_what_differs_in_more_than_four_bits(spark):
    base = [f"w{i * 37 % 101}" for i in range(90)]
    near = [*base[:45], "edit", *base[46:]]
    texts = [" ".join(base), " ".join(near), " ".join(base[::-1])]
    assert jaccard(*texts[:2]) >= 0.8
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_many_small_sets_that_share_a_hash_are_compared_quickly():
    """A line that all pages have leads nowhere; those that are similar are found all the same."""
    import time

    rng = np.random.default_rng(8)
    sets = [np.unique(np.append(rng.integers(1, 1 << 60, 9, np.uint64), np.uint64(0))) for _ in range(20_000)]
    for i in range(0, 20_000, 100):
        sets[i + 1] = np.unique(np.append(sets[i][:9], np.uint64(1)))
    began = time.perf_counter()
    links = similar.forest(sets, 80)
    assert time.perf_counter() - began < 10
    assert sorted(map(tuple, map(sorted, links))) == [(i, i + 1) for i in range(0, 20_000, 100)]


def test_forest_connects_what_is_similar():
    rng = random.Random(9)
    for size in (1, 4, 10, 30):
        pool = [rng.randrange(1 << 60) for _ in range(2 * size)]
        sets = [np.unique(np.array(rng.sample(pool, rng.randint(max(1, size - 1), size + 1)), np.uint64)) for _ in range(80)]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    label = [label[j] if x == label[i] else x for x in label]
        found = list(range(len(sets)))
        links = similar.forest(sets, 80)
        for a, b in links:
            found = [found[a] if x == found[b] else x for x in found]
        same = lambda labels: {tuple(i for i, x in enumerate(labels) if x == own) for own in set(labels)}
        assert same(found) == same(label) and len(links) == len(sets) - len(set(label))


def test_bands_are_of_32_bits_and_pairs_at_the_limit_meet():
    rng = np.random.default_rng(10)
    assert similar._TIMES.dtype == similar._PLUS.dtype == np.uint32
    for size in (9, 90, 3_600):
        for _ in range(40):
            pool = np.unique(rng.integers(0, 1 << 63, size * 10 // 9, np.uint64))
            cut = len(pool) // 10
            assert set(similar.bands(pool[cut:])) & set(similar.bands(pool[: len(pool) - cut]))


def test_buckets_of_three_are_settled_by_their_ends(spark, monkeypatch):
    base = [f"w{i * 37 % 101}" for i in range(90)]
    texts = [" ".join(base), *(" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in (10, 50))]
    rest = []
    monkeypatch.setattr(similar, "bucket_links", lambda x, *y, f=similar.bucket_links: rest.append(x.count()) or f(x, *y))
    monkeypatch.setattr(similar, "bands", lambda found: [1])
    docs = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, "nothing like the others at all here")], "doc_id long, text string")
    assert sorted(map(tuple, similar.similar_duplicates(docs).collect())) == [(0, 0), (1, 0), (2, 2)]
    assert rest == [0]
    more = docs.union(spark.createDataFrame([(3, texts[2]), (4, "another text that is unlike all these")], docs.schema))
    assert sorted(map(tuple, similar.similar_duplicates(more).collect())) == [(0, 0), (1, 0), (2, 2), (3, 0), (4, 4)]
    assert rest == [0, 5]
