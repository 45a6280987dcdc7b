"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointspark.llm import spelling
from pointspark.llm.queries import op13_spelling_variants


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_force(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    # Near words have a text with one letter left out in common, or are one.
    by_rest = {}
    for w in n:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest.setdefault(rest, set()).add(w)
    near = {w: set() for w in n}
    for group in by_rest.values():
        for a in group:
            near[a].update(b for b in group if is_near(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def run(spark, docs):
    frame = spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abé", max_size=7), max_size=60))
def test_composition_accepts_the_pairs_at_one_edit(words):
    words = sorted(words)
    left, right = spelling.near_numbers(words)
    found = sorted(tuple(sorted(x)) for x in zip(left.tolist(), right.tolist(), strict=True))
    assert found == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if is_near(words[i], words[j])]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="ab", max_size=6), max_size=40), st.integers(0, 3))
def test_edits_with_few_letters_behind(words, most):
    words = sorted(words)
    found = {tuple(sorted(x)) for x in zip(*(x.tolist() for x in spelling.near_numbers(words, most)), strict=True)}
    wanted = set()
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
            if is_near(a, b) and (len(a) != len(b) or tail <= most):
                wanted.add((j, i))
    same_length = {p for p in wanted if len(words[p[0]]) == len(words[p[1]])}
    assert {p for p in found if len(words[p[0]]) == len(words[p[1]])} == same_length
    assert found <= wanted


def test_acceptor_is_minimal():
    words = sorted({a + b + c for a in ("", "x", "yz") for b in ("an", "in") for c in ("", "g", "gs", "ed")})
    own = spelling.Acceptor(words)
    rights = set()
    for w in words:
        for i in range(len(w) + 1):
            rights.add(frozenset(v[i:] for v in words if v[:i] == w[:i]))
    assert len(own.final) == len(rights)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 11))) for _ in range(40)]

    def change(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdeé") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1 :]])

    words = [(w, 40) for w in base] + [(change(w), rng.choice([1, 2, 3, 4, 5])) for w in base * 4] + [(change(change(w)), 2) for w in base * 2]
    words += [("aaaaaaa", 700), ("aaaaaaaa", 50), ("aaaaaaaaa", 3), ("Straße", 9), ("STRASSEN", 5), ("ÀÉÎÕÜßÿ", 4), ("àÉÎÕÜßÿ", 2), ("x" * 3000, 2), ("x" * 3001, 3)]
    flat = [w for w, n in words for _ in range(n)]
    rng.shuffle(flat)
    out = [(i, " ".join(flat[j : j + 30])) for i, j in enumerate(range(0, len(flat), 30))]
    return [*out, (None, out[0][1]), (3, out[3][1]), (3, out[3][1]), (900, None), (901, ""), (902, "!? 12,3"), (903, "ABCDÀÉ1ABCDEFGß_abcdefgß-ĀABCDEFG×÷")]


def test_equals_comparing_all_pairs(spark, docs):
    found = run(spark, docs)
    assert found == brute_force(docs)
    assert sum(r[1] is not None for r in found) > 20
    assert any(r[1] is not None and r[1] != r[2] for r in found)  # a form that has a form


def test_groups_that_are_split(spark, docs, monkeypatch):
    """Groups of more than three words are split until they are smaller; pairs at the state that is split come by a join."""
    monkeypatch.setattr(spelling, "HELD", 3)
    assert run(spark, docs[:12]) == brute_force(docs[:12])


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "short words")]) == []


def test_query_on_whole_table(spark):
    path = "/root/testdata/sf0.001"
    found = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in op13_spelling_variants(spark, path).collect())
    assert found == brute_force([(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()])
