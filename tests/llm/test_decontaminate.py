import random

import numpy as np

from pointspark.llm import decontaminate as d


def brute(docs, items, shingle=5, percent=80):
    out = set()
    for i, wanted in items:
        n = min(shingle, len(d.words(wanted)))
        own = d.shingle_strings(wanted, n) if n else set()
        for k, text in docs:
            shared = len(own & d.shingle_strings(text, n)) if n else 0
            if own and 100 * shared >= percent * len(own):
                out.add((k, i, shared, len(own)))
    return out


def test_hashes_follow_words():
    a = d.word_hashes("One, two! ÉTÉ_3 two")
    assert len(a) == len(d.words("One, two! ÉTÉ_3 two")) == 4
    assert a[1] == a[3] and len(set(a.tolist())) == 3
    assert (d.word_hashes("x " * 500 + "two")[-1:] == a[1:2]).all()
    assert d.word_hashes(None).size == d.word_hashes(" .,").size == 0
    assert len(np.unique(d.shingle_hashes(a, 2))) == 3


def test_missable_is_exact():
    assert [d.missable(q, 80) for q in (1, 4, 5, 9, 10, 25, 31)] == [0, 0, 1, 1, 2, 5, 6]


def test_found_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 15, 20, 31, 32, 60])]
    items += [(20, None), (21, " ."), (None, "Null id but five words here"), (3, items[3][1]), (22, items[6][1])]
    docs = [(100, None), (101, ""), (102, "w1")]
    for i in range(60):
        text = [word() for _ in range(rng.choice([3, 50, 400, 5000]))]
        for _ in range(3):
            _, item = rng.choice(items[:11])
            passage = item.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "edit"
            at = rng.randrange(len(text))
            text[at:at] = passage
        docs.append((i, " ".join(text)))
    docs += [docs[5], (None, docs[6][1]), (200, "a NULL id, but five words here. end")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item int")
    wanted = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string")
    found = d.contaminated(table, wanted).collect()
    got = [(r.doc_id, r.item_id, r.shared, r.size) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)
    bad = {t for k, t in docs if any(g[0] == k for g in got)}
    kept = d.drop_contaminated(table, wanted).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted((i or -1, t or "") for i, t in docs if t not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = docs.toDF("item_id", "text")
    assert d.contaminated(docs.limit(0), items).collect() == []
    assert d.contaminated(docs, items.limit(0)).collect() == []
    assert d.drop_contaminated(docs, items.limit(0)).count() == 1


def test_a_document_with_the_whole_benchmark_and_items_of_one_template(spark, monkeypatch):
    """Items share a template; documents that hold only that meet none of them, and one with all items is checked in lots."""
    rng = random.Random(11)
    template = "choose the best answer to the following question from the list below and explain why it is right"
    items = [(i, f"{template} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(20))}") for i in range(120)]
    items.append((900, template))
    docs = [(i, f"some words before {template} and some behind {i}") for i in range(50)]
    docs += [(100, " . ".join(t for _, t in items)), (101, f"x {items[7][1]} y")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d, "TOGETHER", 10)
    rows = []
    of = d.verify

    def counting(pairs, *more):
        rows.extend((r.doc, len(r["items"])) for r in pairs.select("doc", "items").collect())
        return of(pairs, *more)

    monkeypatch.setattr(d, "verify", counting)
    got = {(r.doc_id, r.item_id, r.shared, r.size) for r in d.contaminated(table, wanted).collect()}
    assert got == brute(docs, items) and len(got) == 50 + 121 + 2
    # The template's own item for each document, and what is really there; not 120 items for each.
    assert sum(n for _, n in rows) == len(got)
    assert max(n for _, n in rows) < 40


def test_signatures_avoid_what_many_items_have(spark):
    items = [(f"i{i}", "a b c d e f g h i j " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)]
    frame = spark.createDataFrame(items, "item string, text string")
    signed = d.signatures(frame, 5, 80, common=10).collect()
    shared = set(d.shingle_hashes(d.word_hashes("a b c d e f g h i j"), 5).view(np.int64).tolist())
    assert len({r.item for r in signed}) == 40 and not shared & {r.hash for r in signed}
    assert {(sum(s.item == "i3" for s in signed), r.need) for r in signed} == {(d.missable(63, 80) + 1, d.missable(63, 80) + 1 - d.missable(36, 80))}
    plain = d.signatures(frame, 5, 80, common=1000).collect()
    assert shared & {r.hash for r in plain}
