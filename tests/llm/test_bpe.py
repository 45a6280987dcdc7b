"""Encoding by the pair occurrence index against the library and against merging one word at a time."""

import hashlib
import json

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointspark.llm import bpe, subwords
from pointspark.llm.queries import op11_pair_index_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na\t b", "don't I'LL we've", "12 345 6,7.8", "x<|endoftext|> y", "<|endoftext|><|endoftext|>",
    " <|endoftext|> ", "<|endoftext", "éÉ çà ß ÿ İ ı", "日本語 テキスト 😀👍🏽 é", "\x85 \xa0a  b", "a" * 5000, "ab" * 3000 + " c", "word. word, word; ...!!", "퟿\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def one_by_one(word: bytes, index: bpe.PairIndex) -> list[int]:
    """The rule of BPE: while any pair has a rank, merge the leftmost pair of the lowest."""
    ids = [int(index.byte_id[b]) for b in word]
    while True:
        ranks = [(index.rank[a << bpe.BITS | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << bpe.BITS | b in index.rank]
        if not ranks:
            return ids
        rank, i = min(ranks)
        ids[i : i + 2] = [index.pairs[rank][2]]


def test_ids_and_decoded_text_are_the_library_s(spark, library):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(3, "a"), (None, "no id")]
    docs = spark.createDataFrame([(i, x, "clash", 7) for i, x in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    found = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    expected = []
    for i, x in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        expected.append((i, len(ids), b"".join(n.to_bytes(4, "little") for n in ids), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0], r[3])
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in found], key=key) == sorted(expected, key=key)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabcethn \n\t.,'!0123éß日😀́<|>endoftext"), max_size=60), min_size=1, max_size=6))
def test_any_texts(texts):
    ids, counts = bpe.encoder(PATH).ids(texts)
    expected = [x.ids for x in subwords.load(PATH).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


def test_merging_together_is_merging_one_by_one():
    index = bpe.PairIndex(PATH)
    words = [b" thentionand", b"aaaaaaa", b" internationalisation", "çaéîô".encode(), b"\xff\xfe\x00", b" a", b"!", b" ththth"] * 3
    ids, sizes = index.encode(words)
    assert sizes.tolist() == [len(one_by_one(w, index)) for w in words]
    assert ids.tolist() == [i for w in words for i in one_by_one(w, index)]


def test_a_merge_that_makes_a_pair_of_lower_rank(tmp_path):
    """Ranks need not ascend along a word: here (a, bc) comes after the pair of its result."""
    letters = subwords.byte_letters()
    vocab = {chr(letters[b]): b for b in range(256)} | {"bc": 256, "abc": 257, "abcd": 258}
    merges = ["abc d", "b c", "a bc"]
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    index = bpe.PairIndex(str(path))
    assert index.encode([b"abcd", b"abc", b"xabcdabcd"])[0].tolist() == [258, 257, ord("x"), 258, 258]


def test_memory_is_bounded_and_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "WORDS", 40)
    monkeypatch.setattr(bpe, "INDEXED", 50)
    own = bpe.Encoder(PATH)
    for round_ in range(6):
        texts = [f"word{round_} and word{i} of the {'x' * 100}{i}" for i in range(20)]
        ids, _ = own.ids(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
        assert not any(len(x) > subwords.LONG for x in [*own, *own.words])
        assert len(own.row) < 40 + 20 * 7


def test_bytes_that_are_no_text_and_unknown_ids(spark):
    ids = pa.array([bpe.encoder(PATH).index.byte_id[b] for b in (0xC3, 0x41, 0xA9)]).to_pylist()
    raw = b"".join(i.to_bytes(4, "little") for i in [*ids, 4_000_000_000])
    frame = spark.createDataFrame([(1, 4, bytearray(raw))], "doc_id long, n_tokens long, ids binary")
    assert bpe.decode(frame, PATH).first().text == "�A�"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0


def test_query_on_whole_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op11_pair_index_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        own = found[doc.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(b"".join(n.to_bytes(4, "little") for n in ids)).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
