import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointspark.llm import token_counts, token_files

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " ",
    "Hello, World! it's  fine\n\n to\tgo 12345 <|endoftext|> next",
    "Éréier ñandú ß İstanbul Σίσυφος ΣΑΣ é  x y",
    "nospace" * 900,
    "<|endoftext|>" * 200,
    "<|startoftext|>a<|endoftext|> b",
    "word " * 700 + "  \n" * 30 + "end. " * 50,
    "漢字かな" * 300 + " mix " * 100,
    ("a1,b2;" * 40 + " ") * 20,
    "x" * 100 + " " * 500 + "y",
    "́ ́a\ń",
    "same",
    "same",
]


def table(spark):
    rows = [(i if i != 13 else None, t, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 512), (200, 80), (500, 100)])
def test_counts_equal_the_library(spark, chunk, overlap):
    want = {i if i != 13 else None: len(Tokenizer.from_file(BYTE).encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    found = token_counts.count_tokens(table(spark), BYTE, chunk=chunk, overlap=overlap).collect()
    assert {r.doc_id: r.n_tokens for r in found} == want
    assert {r.doc_id: r.n_bytes for r in found}[4] == len(TEXTS[4].encode())
    assert len(found) == len(TEXTS)


def test_long_texts_with_the_default_chunk(spark):
    rng = np.random.default_rng(3)
    words = np.array(["alpha", "beta,", "gamma", "漢字", "É", "12345", "\n\n", "x" * 40, "<|endoftext|>", "end."])
    texts = [" ".join(words[rng.integers(0, 10, n)]) for n in (9_000, 40_000, 90_000)] + ["y" * 300_000]
    library = Tokenizer.from_file(BYTE)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTE).collect()} == want


def test_chunks_of_one_text_go_to_several_tasks(spark):
    text = "漢字 and words " * 100_000
    chunks = token_counts.cut(spark.createDataFrame([("k", text)], "row_key string, text string"), token_counts.CHUNK, token_counts.OVERLAP)
    rows = chunks.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) == 4
    step = token_counts.CHUNK - token_counts.OVERLAP
    assert sorted((r.chunk, r.begins) for r in rows) == [(i, i * step) for i in range(len(rows))]
    assert all(text[r.begins : r.begins + token_counts.CHUNK] == r.text for r in rows)
    assert [r.chunk for r in rows if r["last"]] == [len(rows) - 1] and max(r.begins + len(r.text) for r in rows) == len(text)


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(table(spark).limit(0), BYTE).collect() == []


def test_files_equal_the_library(spark, tmp_path):
    library = Tokenizer.from_file(WORD)
    want, start = [], 0
    order = sorted(range(len(TEXTS)), key=lambda i: (i != 13, i))
    for i in order:
        ids = [*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        want.append((None if i == 13 else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = str(tmp_path / "files")
    token_files.write_documents(table(spark).repartition(3), path, WORD, 2)
    found = token_files.read_ids(spark, path).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1]) == want
    assert np.frombuffer(found[0].ids, "<u4")[-1] == 2


def test_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_documents(table(spark).limit(0), path, WORD, 2)
    assert token_files.read_ids(spark, path).collect() == []


def test_code_lengths_are_limited_and_optimal():
    rng = np.random.default_rng(1)
    for counts in ([5], [1, 1], [1, 1, 2, 4, 8, 16, 32, 64, 128], rng.integers(1, 1000, 300), 2 ** np.arange(30)):
        counts = np.asarray(counts)
        lengths = token_files.code_lengths(counts, 12)
        assert lengths.max() <= 12
        assert len(counts) == 1 or (2.0 ** -lengths).sum() == 1
    import heapq

    counts = rng.integers(1, 50, 40)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert (token_files.code_lengths(counts, 16) * counts).sum() == cost


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 10_000, 5000)
    ids, lengths, codes = token_files.canonical_codes(np.arange(5000), token_files.code_lengths(counts))
    code, length = np.zeros(5000, np.uint64), np.zeros(5000, np.int64)
    code[ids], length[ids] = codes, lengths
    table = token_files.decode_table(ids, lengths, 16)
    parts = [rng.integers(0, 5000, n) for n in (1, 127, 128, 129, 10_000, 3)]
    packed = [(*token_files.pack(p, code, length), len(p)) for p in parts]
    for got, p in zip(token_files.unpack(packed, table, 16), parts, strict=True):
        assert (got == p).all()


def test_letters_are_encoded_as_by_the_library():
    from pointspark.llm import subwords

    letters = [chr(c) for c in range(0x60, 0x400) if chr(c).isalpha()]
    pieces = [a + b for a in letters for b in ("", "x", "É", ".", "x,", "1.", "\u0301", "x.y")] + ["x" + a + "Z" for a in letters]
    for path, memo in ((WORD, subwords.IdMemo(WORD)), (BYTE, subwords.CountMemo(BYTE))):
        library = Tokenizer.from_file(path)
        for piece, want in zip(pieces, library.encode_batch([" " + p for p in pieces], add_special_tokens=False), strict=True):
            got = list(memo.rows[memo[piece]]) if path == WORD else memo[piece]
            assert got == (want.ids if path == WORD else len(want.ids)), piece


def test_chunks_widen_beside_failed_junctions_only():
    spans = [(0, 100, 0, False), (90, 190, 10, False), (180, 280, 10, True), (270, 370, 10, False), (360, 460, 10, False)]
    assert token_counts.widened(spans) == [(0, 100, 0, 90, False), (90, 260, 10, 180, True), (180, 280, 80, 270, True), (270, 370, 10, 360, False), (360, 460, 10, None, False)]
    # An overlap that would cover the right chunk takes it in, and the next one; its other neighbour stays as it is.
    spans = [(0, 100, 0, False), (20, 120, 80, True), (90, 190, 30, True), (180, 280, 10, False)]
    assert token_counts.widened(spans) == [(0, 190, 0, 180, True), (180, 280, 10, None, False)]
    assert token_counts.widened([(0, 5, 0, False)]) == [(0, 5, 0, None, False)]


def test_only_neighbours_of_failed_junctions_are_encoded_again(spark, monkeypatch):
    """One run of letters over several chunks of a long text: few characters are encoded twice, and counts are the library's."""
    text = "some words and 123 numbers, " * 1500 + "q" * 9_000 + " and words again. " * 1500 + "É" * 700 + " end " * 500
    encoded, of = [], token_counts.chunk_counts

    def counting(chunks, path):
        encoded.append(chunks.select(F.sum(F.length("text"))).first()[0])
        return of(chunks, path)

    monkeypatch.setattr(token_counts, "chunk_counts", counting)
    docs = spark.createDataFrame([(1, text), (2, "plain words " * 2000)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTE, chunk=2000, overlap=100).collect()}
    library = Tokenizer.from_file(BYTE)
    assert found == {1: len(library.encode(text, add_special_tokens=False).ids), 2: len(library.encode("plain words " * 2000, add_special_tokens=False).ids)}
    assert len(encoded) >= 3 and sum(encoded[1:]) < 0.8 * len(text)
