"""Spelling variants by finite-state composition.

Words are grouped by their first letters; a group is the partition of the
composition that begins in the state which these letters reach.  There, the
words' rests become a minimal acyclic acceptor A, and A o E o A, with the
transducer E of one edit, is walked: before the edit both sides are in the same
state s; a replacement leads to two arcs' targets of s, an insertion or deletion
to an arc's target and s itself; after it both sides read the same letters.
Each state counts the words that it accepts, so a path is a word's number, and
accepted pairs come out as numbers.  A state's 64-bit mask of hashed rests cuts
walks off that can't end together.

Pairs that differ within the first letters share their last ones, and are found
by the same walk over the reversed words.  A group with more than ``HELD`` words
is split by one more letter; the edits at the state that is split lead to what
follows being equal on both sides, which is an equi-join.

A task returns, for each word, how many near words it has found and the best of
them, not pairs; so what leaves it is no more than what came in.

Defined results: null, empty and wordless texts have no words; a null document
id is written as nothing before the colon; repeated rows count again; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import UPPER, row_key, save

MIN_CHARS = 7
MIN_COUNT = 2
#: How much more frequent a word's form is at least.
RATIO = 10
#: Letters at either end by which words are grouped.
ENDS = 3
#: Words of a group.
HELD = 50_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 500_000
EVERY = 31

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % MIN_CHARS)
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_MASK, _EVEN = (1 << 64) - 1, 0x5555555555555555


def misspelt(doc_id, run: str, prefix: int) -> str:
    """The run without one code point where its hash says so; ``prefix`` is the crc32 of what stands before the run."""
    h = zlib.crc32(run.encode(), prefix)
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def text_words(doc_id: int | None, text: str | None) -> Counter:
    """The words of a document, with its misspellings, and how often each occurs."""
    runs = Counter(_RUN.findall((text or "").encode().translate(_LOWER).decode()))
    prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out: Counter = Counter()
    for run, n in runs.items():
        word = misspelt(doc_id, run, prefix)
        if len(word) >= MIN_CHARS:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words that occur often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in text_words(doc_id.as_py(), text.as_py()).items():
                    held[word] = held.get(word, 0) + n
                if len(held) >= COUNTED:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words; ``root`` is its initial state.

    ``arc``: target, letter, skip (words of the state before the arc's), by
    state and letter; ``first``: a state's first arc.  ``final``, ``mask`` and
    ``least`` (letters to the nearest end) are by state.
    """

    def __init__(self, words: list[str]):
        register: dict[tuple, int] = {}
        self.final, self.mask, self.least, arcs, count = [], [], [], [], []

        def freeze(node: list) -> int:
            signature = (node[0], *node[1])
            state = register.get(signature)
            if state is None:
                state = register[signature] = len(count)
                total, mask, least, own = int(node[0]), int(node[0]), 0 if node[0] else 1 << 30, []
                for letter, target in node[1]:
                    own.append((target, letter, total))
                    total += count[target]
                    turn, below = letter * 0x9E3779B1 >> 7 & 63, self.mask[target]
                    below = (below << turn | below >> (64 - turn)) & _MASK
                    mask |= (below & _EVEN) << 1 | below >> 1 & _EVEN  # so that the order of letters counts
                    least = min(least, self.least[target] + 1)
                self.final.append(node[0])
                self.mask.append(mask)
                self.least.append(least)
                arcs.append(own)
                count.append(total)
            return state

        path: list[list] = [[False, []]]
        before = ""
        for word in words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((ord(before[len(path) - 1]), freeze(node)))
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            before = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((ord(before[len(path) - 1]), freeze(node)))
        self.root = freeze(path[0])
        self.first = np.cumsum([0, *map(len, arcs)])
        self.target, self.letter, self.skip = (np.array([a[i] for own in arcs for a in own], np.int64) for i in range(3))
        self.final, self.mask, self.least = np.array(self.final), np.array(self.mask, np.uint64), np.array(self.least)
        self.key = np.repeat(np.arange(len(arcs)), np.diff(self.first)) << 21 | self.letter


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of rows that begin at ``starts`` with ``sizes``, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def edited(own: Acceptor, most: int | None) -> list[np.ndarray]:
    """What A o E o A holds behind the edit's arcs: state of the edit, states and word numbers of both sides, letter that may not follow.

    Replacements come in one order of their two letters.  Of the places where a
    letter of a run can be deleted only the last counts, so the deleted letter
    may not follow.  ``most`` bounds the letters behind the edit.
    """
    degree = np.diff(own.first)
    state = np.repeat(np.arange(len(degree)), degree)
    usable = own.least[own.target] <= (most if most is not None else 1 << 30)
    arc = np.flatnonzero(usable)
    inserted = [state[arc], own.target[arc], state[arc], own.skip[arc], np.zeros(len(arc), np.int64), own.letter[arc]]
    later = own.first[state[arc] + 1] - arc - 1
    left = np.repeat(arc, later)
    right = ragged(arc + 1, later)
    left, right = left[usable[right]], right[usable[right]]
    replaced = [state[left], own.target[left], own.target[right], own.skip[left], own.skip[right], np.full(len(left), -1)]
    return [np.concatenate(x) for x in zip(inserted, replaced, strict=True)]


def near_numbers(words: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): numbers of the sorted distinct words that differ by exactly one edit, each pair once.

    With ``most``, only edits with at most so many letters behind.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = Acceptor(words)
    if not len(own.target):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    degree = np.diff(own.first)
    here = edited(own, most)
    found, depth = [], 0
    while len(here[0]):
        origin, a, b, i, j, banned = (x[(own.mask[here[1]] & own.mask[here[2]]) != 0] for x in here)
        end = own.final[a] & own.final[b]
        found.append((origin[end], i[end], j[end]))
        if most is not None and depth >= most:
            break
        swap = degree[a] > degree[b]
        a, b, i, j = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, j, i), np.where(swap, i, j)
        sizes = degree[a]
        arc = ragged(own.first[a], sizes)
        letter = own.letter[arc]
        wanted = np.repeat(b, sizes) << 21 | letter
        other = np.minimum(np.searchsorted(own.key, wanted), len(own.key) - 1)
        same = np.flatnonzero((own.key[other] == wanted) & (letter != np.repeat(banned, sizes)))
        arc, other, of = arc[same], other[same], np.repeat(np.arange(len(a)), sizes)[same]
        turned = swap[of]
        a, b, i, j = own.target[arc], own.target[other], i[of] + own.skip[arc], j[of] + own.skip[other]
        here = [origin[of], np.where(turned, b, a), np.where(turned, a, b), np.where(turned, j, i), np.where(turned, i, j), np.full(len(of), -1)]
        depth += 1
    origin, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(origin):
        return origin, i
    # All ways from the initial state to states with an edit; a way is the number of its first word.
    leads = np.zeros(len(degree), bool)
    leads[origin] = True
    state, number, reached = np.array([own.root]), np.zeros(1, np.int64), []
    while len(state):
        reached.append((state[leads[state]], number[leads[state]]))
        arc = ragged(own.first[state], degree[state])
        state, number = own.target[arc], np.repeat(number, degree[state]) + own.skip[arc]
    state, number = (np.concatenate(x) for x in zip(*reached, strict=True))
    order = np.argsort(state, kind="stable")
    state, number = state[order], number[order]
    low, high = np.searchsorted(state, origin), np.searchsorted(state, origin, "right")
    way = number[ragged(low, high - low)]
    return way + np.repeat(i, high - low), way + np.repeat(j, high - low)


def best_near(words: list[str], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, n_near, near_n, near) by number: words with near ones, how many, and the most frequent and then smallest of these."""
    a, b = np.concatenate([left, right]), np.concatenate([right, left])
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    word, first, count = np.unique(a, return_index=True, return_counts=True)
    return word, count, n[b[first]], b[first]


NEAR = "word string, n_near long, near_n long, near string"


def compose(groups: DataFrame, backwards: bool) -> DataFrame:
    """Rows NEAR for words (key, word, n) that share their first or, ``backwards``, their last ``len(key)`` letters.

    Forwards, words are near that share their first ENDS letters; backwards, those that don't.
    """

    def run(table: pa.Table) -> pa.Table:
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        same = len(table["key"][0].as_py())
        rests = [w[::-1][same:] if backwards else w[same:] for w in words]
        order = sorted(range(len(rests)), key=rests.__getitem__)
        left, right = near_numbers([rests[i] for i in order], ENDS - 1 if backwards else None)
        order = np.array(order, np.int64)
        left, right = order[left], order[right]
        if backwards:
            start = np.unique([w[:ENDS] for w in words], return_inverse=True)[1]
            apart = start[left] != start[right]
            left, right = left[apart], right[apart]
        # Numbers by word, so that the smaller of two words has the smaller number.
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        word, count, near_n, near = best_near(words, n[order], place[left], place[right])
        name = lambda at: pa.array([words[i] for i in order[at].tolist()], pa.string())
        return pa.table({"word": name(word), "n_near": pa.array(count, pa.int64()), "near_n": pa.array(near_n, pa.int64()), "near": name(near)})

    return groups.select("key", "word", "n").groupBy("key").applyInArrow(run, NEAR)


def split_edits(words: DataFrame, backwards: bool) -> DataFrame:
    """Rows NEAR for edits right behind the key of groups that are split: what follows is equal, so it is a join.

    A key of this join has at most as many words as there are letters.
    """
    follows = F.when(F.lit(backwards), F.reverse("word")).otherwise(F.col("word"))
    at = F.length("key") + 1
    rows = words.withColumn("own", follows)
    # Backwards, only edits among the first letters count.
    rows = rows.where(F.length("own") <= F.length("key") + ENDS) if backwards else rows
    rest, cut = F.substr("own", at), F.substr("own", at + 1)
    letter = F.substr("own", at, F.lit(1))
    kinds = [("replaced", cut, cut), ("long", cut, None), ("short", None, rest)]
    sides = {}
    for name, first, second in kinds:
        follow = first if first is not None else second
        keyed = rows.where(F.length("own") >= at) if name != "short" else rows
        sides[name] = keyed.select(row_key("key", follow).alias("meet"), "word", "n", letter.alias("letter"), follow.alias("follow"))
    replaced = sides["replaced"].alias("l").join(sides["replaced"].alias("r"), (F.col("l.meet") == F.col("r.meet")) & (F.col("l.word") != F.col("r.word")))
    long_short = sides["long"].alias("l").join(sides["short"].alias("r"), (F.col("l.meet") == F.col("r.meet")) & ~F.startswith(F.col("r.follow"), F.col("l.letter")))
    pick = lambda joined, a, b: joined.select(F.col(f"{a}.word").alias("word"), F.col(f"{b}.word").alias("near"), F.col(f"{b}.n").alias("near_n"))
    pairs = pick(replaced, "l", "r").union(pick(long_short, "l", "r")).union(pick(long_short, "r", "l"))
    if backwards:
        pairs = pairs.where(F.substring("word", 1, ENDS) != F.substring("near", 1, ENDS))
    return combine(pairs.select("word", F.lit(1).cast("long").alias("n_near"), "near_n", "near"))


def combine(parts: DataFrame) -> DataFrame:
    """Rows NEAR, one for each word."""
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near"))


def near_words(words: DataFrame) -> DataFrame:
    """Rows NEAR of the words (word, n), one for each word that has near ones."""
    parts = []
    for backwards in (False, True):
        follows = F.reverse("word") if backwards else F.col("word")
        rest = words.select(F.substring(follows, 1, ENDS).alias("key"), "word", "n")
        while True:
            sizes = rest.groupBy("key").count().where(F.col("count") > HELD).select("key")
            heavy = save(sizes, "heavy-groups")
            if heavy.isEmpty():
                parts.append(compose(rest, backwards))
                break
            parts.append(compose(rest.join(heavy, "key", "left_anti"), backwards))
            split = save(rest.join(heavy, "key"), "split-groups")
            parts.append(split_edits(split, backwards))
            follows = F.reverse("word") if backwards else F.col("word")
            rest = save(split.select(F.substr(follows, F.lit(1), F.length("key") + 1).alias("key"), "word", "n", F.length("key").alias("was")).where(F.length("key") > F.col("was")).drop("was"), "longer-keys")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return combine(found)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last form that is reached.  Forms grow in frequency tenfold, so ways are short, and each round doubles them."""
    here = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = here.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = here.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        here = save(further, "roots")
        if here.where("moved").isEmpty():
            return here.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word."""
    words = save(vocabulary(docs, id_col, text_col, min_count=min_count), "vocabulary")
    near = save(words.join(near_words(words), "word", "left"), "near-words")
    fits = F.col("near_n") >= ratio * F.col("n")
    formed = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    ways = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
