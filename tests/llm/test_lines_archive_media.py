import hashlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pointspark.llm import line_dedup, media, warc

LINE = "a line of more than twenty code points"


def slow_dedup(docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        own = -(2**63) if i is None else i
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and own != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(4, 2), (1, 2), (7, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    docs = [
        (1, None), (2, ""), (3, LINE), (4, f"  {LINE.upper()}\t\nshort\n{LINE}"), (5, f"x\n{LINE}\x0b\n"), (5, f"x\n{LINE}\x0b\n"),
        (6, "ÉTÉ " * 5 + "\n" + "été " * 5), (7, "été " * 5), (8, "ÉTÉ " * 5), (9, "Été " * 5 + "\n\n"), (10, "été " * 5),
        (None, LINE), (11, "twenty code points!!\n" * 3), (12, "twenty code points!!"), (13, "Twenty code points!!\r"), (14, "19 code points ..... "),
    ]
    docs += [(100 + i, f"line {i} is unique to this document\n{LINE if i % 2 else 'another line that many documents share'}") for i in range(40)]
    table = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, h1 int").repartition(3)
    found = line_dedup.dedup_lines(table, batches=batches, fanout=fanout).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found), key=str) == slow_dedup(docs)
    assert {r.h1 for r in found} == {5}


def test_a_text_of_many_lines(spark):
    """Time in proportion to the lines, where some of them are dropped."""
    text = "\n".join(f"line number {i} of a long text" for i in range(60_000)) + f"\n{LINE}"
    docs = spark.createDataFrame([(1, text), (2, LINE), (3, LINE)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 90
    assert (found[1].n_lines, found[1].n_dropped) == (60_001, 1) and found[1].kept == text[: -len(LINE) - 1]


def test_new_keys_are_those_that_no_run_has(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    keys = lambda rows: spark.createDataFrame([(h, h, d) for h, d in rows], "h1 long, h2 long, doc long")
    seen = []
    for batch in ([(1, 9), (2, 9), (1, 8)], [(2, 7), (3, 7)], [(3, 5), (4, 5), (1, 5)], []):
        seen.append(sorted((r.h1, r.keeper) for r in runs.add_batch(keys(batch)).collect()))
    assert seen == [[(1, 9), (2, 9)], [(3, 7)], [(4, 5)], []]
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted((r.h1, r.n, r.keeper) for r in runs.merged().collect()) == [(1, 3, 9), (2, 2, 9), (3, 2, 7), (4, 1, 5)]


def test_runs_are_read_as_they_lie(spark):
    """Neither side of the anti-joins is moved or sorted, and compaction moves nothing."""
    runs = line_dedup.LineRuns(spark, fanout=3)
    for low in (0, 500):
        runs.add_batch(spark.range(low, low + 700).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), F.lit(low).cast("long").alias("doc")))
    keys = runs.batch_keys(spark.range(900, 1500).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), F.lit(1).cast("long").alias("doc")))
    with line_dedup.as_they_lie(spark):
        new = runs.fresh(keys)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort [" not in plan
        assert sorted(r.h1 for r in new.collect()) == list(range(1200, 1500))
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    names = list(runs.names)
    assert all(spark.catalog.tableExists(n) for n in names)
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_archive_round_trip(spark, tmp_path):
    big, small = "é" * 500, "x" * 999
    pages = [(1, "u1", big), (2, "u2\r\nX: y", big), (3, None, small), (4, "u4", small), (5, "u5", None), (6, "u6", ""), (7, "u7", "z" * 1000), (2, "again", big), (None, "n", big), (None, "n", "only" * 300)]
    path = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int"), path)
    rows = warc.read_archive(spark, path).collect()
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in rows)
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if h == html and p is not None]
        response = len(raw) < 1000 or i == max(same, default=None)
        want.append((i or 0, len(raw), hashlib.sha1(raw).hexdigest(), "response" if response else "revisit", 0 if response else max(same)))
    assert got == sorted(want)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    records = {r.record for r in warc.original_records(warc.read_archive(spark, path)).collect()}
    first = next(x for x in records if b"urn:page:7>" in x)
    head, _, block = first.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 1000" in head
    assert block == b"z" * 1000 + b"\r\n\r\n"
    assert b"\r\nX: y" not in b"".join(records)


def test_ids_of_other_types(spark, tmp_path):
    path = str(tmp_path / "s")
    warc.write_archive(spark.createDataFrame([("p-1", "u", "x" * 2000), ("p-2", "u", "x" * 2000)], "page_id string, url string, html string"), path)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(spark, path, "string").collect()) == [("p-1", "revisit", "p-2"), ("p-2", "response", None)]


def test_a_changed_payload_is_noticed(spark, tmp_path):
    path = str(tmp_path / "b")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    spark.createDataFrame([(hashlib.sha256(b"text").hexdigest(), bytearray(b"other"))], "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


def test_html_sequences():
    html = """<!doctype html><title>T &amp; x</title><style>p{}</style><script>var a = "</p>";</script>
    <p>One <b>bold</b> text<img src="a.png" alt="pic">after<figure><img src=b.png><img src='c.png'><figcaption> A  caption </figcaption></figure><p>end <img alt="none">"""
    found = [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.html_sequence(html)]
    assert found == [
        (0, "text", "T & x", None), (1, "text", "One bold text", None), (2, "media", "a.png", "pic"), (3, "text", "after", None),
        (4, "media", "b.png", "A caption"), (5, "media", "c.png", "A caption"), (6, "text", "end", None),
    ]
    assert media.html_sequence(None) == media.html_sequence("") == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<figure><figcaption>cap</figcaption><img src=a.png></figure>", [("a.png", "cap")]),
        ("<img src=a alt=x><img src=b><figcaption>stray</figcaption>", [("a", "x"), ("b", None), "stray"]),
        ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>", [("a", "out"), ("b", "in")]),
        ("<figure><img src=a><figcaption>cap</figure><p>text</p>", [("a", "cap"), "text"]),
        ("<div><figure><img src=a><figcaption>cap</div><p>text</p><img src=b>", [("a", "cap"), "text", ("b", None)]),
        ("<template>x<template>y</template>z</template>after", ["after"]),
        ("<figure><p>t1</p><figcaption>c <b>d</b></figcaption><table><tr><td>t2</td></tr></table></figure>end", ["t1", "c d", "t2", "end"]),
        ("<figure><figcaption>one<p>two</p>", ["one two"]),
        ("<noscript><img src=a alt=b></noscript></figure></figcaption>tail", [("a", "b"), "tail"]),
    ],
)
def test_captions(html, want):
    found = media.html_sequence(html)
    assert [(x["ref"], x["caption"]) if x["kind"] == "media" else x["text"] for x in found] == want
    assert [x["position"] for x in found] == list(range(len(found)))


def test_sequences_with_their_payloads(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(3)], "id long, text string")
    stored = media.text_to_media(texts, "id", "text")
    name = {r.id: (f"{media.SCHEME}{r.digest}", r.media) for r in stored.collect()}
    html = f"<p>one<img src='{name[0][0]}' alt=a>two<figure><img src='{name[1][0]}'><img src='{name[0][0]}'><figcaption>c</figcaption></figure><img src='http://x/y.png'>end"
    pages = spark.createDataFrame([(1, html), (None, html), (2, ""), (3, None), (1, "<img src='sha256:0'>")], "id long, html string")
    found = media.resolve_sequences(media.parse_sequences(pages, "id", "html"), stored.union(stored)).collect()
    assert sorted((r.id or 0, len(r["items"])) for r in found) == [(0, 7), (1, 1), (1, 7), (2, 0), (3, 0)]
    items = next(r["items"] for r in found if r.id is None)
    want = ["one", name[0][1], "two", name[1][1], name[0][1], None, "end"]
    assert [x.payload if x.kind == "media" else x.text for x in items] == want
    assert [x.position for x in items] == list(range(7)) and [x.caption for x in items] == [None, "a", None, "c", "c", None, None]


def test_documents_as_media(spark):
    texts = [None, "", "x", "é" * 288, "é" * 289, "long " * 5000, "x"]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.id: r for r in media.documents_as_media(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[i or None]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        assert r.caption.startswith("Text of document") and r.position == 1
    same = [rows[i][k] for k in ("media_sha256", "media_bytes", "feature") for i in (2, 6)]
    assert same[0] == same[1] and same[2] == same[3] and same[4] == same[5]
    assert media.documents_as_media(docs.limit(0)).collect() == []


def test_unresolved_references_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="http://x/a.png" alt="c">')], "id long, html string")
    refs = media.media_references(media.parse_sequences(pages, "id", "html"))
    facts = media.media_facts(media.text_to_media(spark.createDataFrame([(1, "t")], "id long, text string"), "id", "text"))
    (r,) = media.resolve(refs, facts).collect()
    assert (r.position, r.caption, r.digest, r.n_bytes) == (0, "c", None, None)
