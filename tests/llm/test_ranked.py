"""Ranked search against scoring every document; bounds of blocks against the scores of their documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pointspark.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k=ranked.TOP):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, length = len(found), sum(x for *_, x in found)
    held = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c, size in found:
            m = 100 - 90 + 90 * size * n // length
            w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) for t in set(plain_terms(text)) if t in c}
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in w)
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort()
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in ranked.search(d, q, **more).collect()], key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)] + ["Éa", "ÀB", "x9", "日本"]
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda n: "  ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(int(i), text(int(rng.integers(1, 80)))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, " .,!\n\x7f"), (2003, "w1 " * 5000)]
    items = [(i, text(12)) for i in range(25)] + [(100, docs[5][1]), (100, docs[5][1]), (100, "w3 w3 W4"), (101, None), (102, "?!"), (103, "unknown"), (None, "w2 éa ÀB"), (104, "w0")]
    return docs, items


def test_equals_scoring_every_document(spark, corpus):
    docs, items = corpus
    assert run(spark, docs, items) == brute_force(docs, items)


def test_small_blocks_segments_and_query_blocks_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    for name, value in (("BLOCK", 4), ("SEGMENT", 50), ("QUERY_TERMS", 60), ("CELLS", 500), ("STEP", 1)):
        monkeypatch.setattr(ranked, name, value)
    assert run(spark, docs, items, k=3) == brute_force(docs, items, 3)


def segment_of(corpus):
    docs, _ = corpus
    found = [Counter(plain_terms(t)) for _, t in docs if plain_terms(t)]
    number = {t: i for i, t in enumerate(sorted({t for c in found for t in c}))}
    rows = [sorted((number[t], n * (1 + number[t] % 7)) for t, n in c.items()) for c in found]
    ends = np.cumsum([len(r) for r in rows])
    term, impact = np.array([x for r in rows for x in r]).T
    return ranked.Segment(ranked.build_segment(np.arange(len(rows)), ends, term, impact), len(number)), rows


def test_summaries_are_coordinatewise_maxima_and_blocks_cover_lists(corpus, monkeypatch):
    for block, cells in ((64, 2_000_000), (4, 500)):
        monkeypatch.setattr(ranked, "BLOCK", block)
        monkeypatch.setattr(ranked, "CELLS", cells)
        own, rows = segment_of(corpus)
        for i, t in enumerate(own.lists.tolist()):
            members = []
            for b in range(own.list_blocks[i], own.list_blocks[i + 1]):
                docs = own.members[own.block_starts[b] : own.block_ends[b]].tolist()
                members += docs
                most = {}
                for d in docs:
                    for u, x in rows[d]:
                        if u >= t:
                            most[u] = max(most.get(u, 0), x)
                at = slice(own.summary_starts[b], own.summary_ends[b])
                assert dict(zip(own.summary_terms[at].tolist(), own.summary_most[at].tolist(), strict=True)) == most
                assert len(docs) <= 2 * block
            assert sorted(members) == [d for d, r in enumerate(rows) if any(u == t for u, _ in r)]


def test_blocks_are_passed_over_and_results_are_exact(corpus, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 4)
    own, rows = segment_of(corpus)
    rng = np.random.default_rng(5)
    for _ in range(60):
        query = np.unique(rng.integers(0, len(own.asked), 8))
        score = np.array([sum(x for u, x in r if u in set(query.tolist())) for r in rows])
        order = np.lexsort((np.arange(len(rows)), -score))[:10]
        order = order[score[order] > 0]
        best, found = own.search(query, 10)
        assert best.tolist() == order.tolist()
        assert found.tolist() == score[order].tolist()
    assert own.scored < 0.8 * 60 * len(rows)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "  ")], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == []
