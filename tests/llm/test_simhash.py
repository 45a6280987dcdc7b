import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pointspark.llm import simhash


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_fingerprints():
    assert simhash.fingerprint("a b  c d e " * 40, 5) != simhash.fingerprint("a b  c d e " * 40)
    for text in [None, "", " \n", "One", "a b c", "A b  c\td É é", "x y z w " * 50, "Ünï cödé wörds ÀÉ again and again"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_texts_by_pieces(monkeypatch):
    text = " ".join(f"Wörd{i * i % 1009}" for i in range(3000)) + " \n" * 300 + "x" * 400 + " end"
    want = simhash.fingerprint(text)
    assert want == slow_fingerprint(text)
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == want and simhash.fingerprint(" a b ") == slow_fingerprint("a b")


def test_words_two_bits_apart_share_a_key():
    rng = random.Random(3)
    for bits in (23, 18):
        for _ in range(500):
            a = rng.getrandbits(bits)
            b = a
            for bit in rng.sample(range(bits), 2):
                b ^= 1 << bit
            keys, n = simhash.segment_keys(np.array([a, b]), bits)
            assert n.max() <= 6
            assert set(keys[0, : n[0]].tolist()) & set(keys[1, : n[1]].tolist())


@pytest.mark.parametrize("small", [64, 1])
def test_links_equal_brute_force(spark, small, monkeypatch):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for i in range(240):
        x = fps[rng.randrange(len(fps))]
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        fps.append(x)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    links = simhash.fingerprint_links(table).collect()
    place = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fps)}
    label = list(range(len(fps)))
    for r in links:
        a, b = sorted((label[place[r.a]], label[place[r.b]]))
        label = [a if x == b else x for x in label]
    assert label == slow_components(fps)


def test_heavy_keys_go_by_pairs_of_blocks(spark):
    rng = random.Random(7)
    fps = sorted({rng.getrandbits(64) & 0x3FF000000000000 | 0x5 for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)} | {rng.getrandbits(20) << 44 for _ in range(200)})
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    label, place = list(range(len(fps))), {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fps)}
    for r in simhash.fingerprint_links(table, most=20).collect():
        assert (fps[place[r.a]] ^ fps[place[r.b]]).bit_count() <= 4
        a, b = sorted((label[place[r.a]], label[place[r.b]]))
        label = [a if v == b else v for v in label]
    assert label == slow_components(fps)


def test_a_bucket_of_many_fingerprints_is_spread_over_tasks(spark):
    """300,000 members of one key, some of them linked over blocks: groups of at most about HELD, in many tasks, and all links."""
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 62, 300_000))
    linked = fps[:: 1000]
    far = linked ^ (1 << rng.integers(0, 62, len(linked))) ^ (1 << rng.integers(0, 62, len(linked)))
    fps = np.unique(np.concatenate([fps, far]))
    members = spark.createDataFrame(pd.DataFrame({"key": 7, "fp": fps}))
    blocks = -(-len(fps) * 2 // simhash.HELD)
    block = F.pmod(F.xxhash64("fp"), F.lit(blocks))
    sizes = [r["count"] for r in members.groupBy(block.alias("b")).count().collect()]
    assert len(sizes) == blocks and max(sizes) < simhash.HELD * 0.55
    found = {frozenset((r.a, r.b)) for r in simhash.heavy_links(members, simhash.HELD).collect()}
    assert {frozenset(map(int, x)) for x in zip(linked, far, strict=True)} - {frozenset([int(x)]) for x in linked} <= found
    assert all(bin(min(p) ^ max(p)).count("1") <= 4 for p in found)


def test_heavy_keys_are_counted_before_members_are_moved(spark, monkeypatch):
    """The exchange by key never sees a key that is heavy, whose members meet in pairs of blocks from the start."""
    rng = random.Random(12)
    fps = sorted({rng.getrandbits(64) & 0x3FF000000000000 | 0x5 for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    sizes = {r.key: r["count"] for r in simhash.keyed(table).groupBy("key").count().collect()}
    hot = {k for k, n in sizes.items() if n > 50}
    assert hot and {r.key for r in simhash.heavy_keys(table, 50).collect()} == hot
    assert simhash.heavy_keys(table, 100_000) is None
    again = []
    of = simhash.save
    monkeypatch.setattr(simhash, "save", lambda df, name: again.append((name, df.columns)) or of(df, name))
    links = simhash.fingerprint_links(table, most=50)
    label, place = list(range(len(fps))), {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fps)}
    for r in links.collect():
        a, b = sorted((label[place[r.a]], label[place[r.b]]))
        label = [a if v == b else v for v in label]
    assert label == slow_components(fps)
    # Nothing is left for the way back from the exchange.
    assert [c for n, c in again].count(["a", "b", "again"]) == 1 and sum(n == "heavy-blocks" for n, _ in again) == 1


def test_documents(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(200)) for _ in range(6)]
    texts = [None, "", "  ", "one", "One", *base, *base]
    for t in base:
        words = t.split()
        words[rng.randrange(200)] = "edit"
        texts.append(" ".join(words))
    ids = [100 - i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)] + [(None, "one", 2)], "doc_id long, text string, fp int")
    found = simhash.near_duplicates(docs).collect()
    fps = [slow_fingerprint(t) for t in [*texts, "one"]]
    label = slow_components(fps)
    all_ids = [*ids, None]
    want = sorted((i or -1, f"{f:016x}", min(x for x, y in zip(all_ids, label, strict=True) if y == l and x is not None)) for i, f, l in zip(all_ids, fps, label, strict=True))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in found) == want
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
