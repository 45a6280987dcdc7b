"""Interleaved document sequences with media columns.

``parse_sequences`` turns HTML into an ordered array of text and media
reference structs; references name media by digest.  Media are stored once per
row as binary PGM images (8-bit samples, 24 to a row) and resolved by joining
on the digest, so that positions and captions stay with their references.

Defined results: a null text is an empty payload; null HTML is an empty
sequence; repeated rows give repeated results; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import save

WIDTH = 24
FRAME = 576
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
SCHEME = "sha256:"
SKIPPED = {"script", "style", "template"}
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "table", "figure", "figcaption", "blockquote", "pre", "nav", "header", "footer", "title", "body", "html"}
MEDIA = {"img", "video", "audio", "source", "embed"}
#: Blocks without content, and those whose end tags say nothing about what is around them.
VOID, LOOSE = {"br"}, {"br", "p"}


class _Figure:
    """An open figure: its media, and its captions as (place among the items, parts)."""

    def __init__(self) -> None:
        self.media: list[dict] = []
        self.captions: list[tuple[int, list[str]]] = []
        self.inside: list[str] = []  # blocks that were opened in the figure and are open


class _Sequence(HTMLParser):
    """Collects text blocks and media references in document order.

    A figure's captions belong to the media directly in it, in place of their
    ``alt``, and are applied when it closes: at its end tag, at the end of an
    element around it, or at the end of the page.  A figure without media has
    its captions as text, where they stand; so has the page those outside
    figures.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip: list[str] = []
        self.figures: list[_Figure] = []
        self.caption: _Figure | None = None  # the figure whose caption is open

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def close_figure(self) -> None:
        self.flush()
        figure = self.figures.pop()
        if self.caption is figure:
            self.caption = None
        captions = [(at, " ".join("".join(parts).split())) for at, parts in figure.captions]
        text = " ".join(c for _, c in captions if c)
        if figure.media and text:
            for item in figure.media:
                item["caption"] = text
        elif not figure.media:
            for at, caption in reversed(captions):
                if caption:
                    self.items.insert(at, {"kind": "text", "text": caption, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs) -> None:
        if self.skip:
            self.skip += [tag] if tag == self.skip[0] else []
        elif tag in SKIPPED:
            self.skip = [tag]
        elif tag == "figure":
            self.flush()
            self.caption = None
            self.figures.append(_Figure())
        elif tag == "figcaption":
            self.flush()
            if self.figures:
                self.caption = self.figures[-1]
                self.caption.captions.append((len(self.items), []))
        elif tag in MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                self.items.append({"kind": "media", "text": None, "ref": found["src"], "caption": found.get("alt")})
                if self.figures:
                    self.figures[-1].media.append(self.items[-1])
        elif tag in BLOCKS:
            self.block()
            if self.figures and tag not in VOID:
                self.figures[-1].inside.append(tag)

    def block(self) -> None:
        """A block begins or ends: a new text, or a blank inside a caption."""
        if self.caption:
            self.caption.captions[-1][1].append(" ")
        else:
            self.flush()

    def handle_endtag(self, tag) -> None:
        if self.skip:
            self.skip = self.skip[1:] if tag == self.skip[0] else self.skip
        elif tag == "figcaption":
            self.flush()
            self.caption = None
        elif tag == "figure":
            if self.figures:
                self.close_figure()
            else:
                self.flush()
        elif tag in BLOCKS:
            # The end of an element around a figure ends the figure.
            while self.figures and tag not in self.figures[-1].inside and tag not in LOOSE:
                self.close_figure()
            self.block()
            if self.figures and tag in self.figures[-1].inside:
                inside = self.figures[-1].inside
                del inside[len(inside) - 1 - inside[::-1].index(tag) :]

    def handle_data(self, data) -> None:
        if not self.skip:
            (self.caption.captions[-1][1] if self.caption else self.words).append(data)

    def finish(self) -> None:
        while self.figures:
            self.close_figure()
        self.flush()


def html_sequence(html: str | None) -> list[dict]:
    """The ordered items of one page."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.finish()
    return [{"position": i} | item for i, item in enumerate(parser.items)]


def parse_sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items): HTML parsed into an ordered array of structs."""
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            found = [html_sequence(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, items)], ["id", "items"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(parse, f"id {kind}, items {SEQUENCE}")


def media_references(sequences: DataFrame) -> DataFrame:
    """A row for each media reference: id, position, caption, digest (null where it names no stored media)."""
    item = F.explode("items").alias("item")
    digest = F.when(F.startswith("item.ref", F.lit(SCHEME)), F.substring("item.ref", len(SCHEME) + 1, 64))
    return (
        sequences.select("id", item)
        .where("item.kind = 'media'")
        .select("id", "item.position", "item.caption", "item.ref", digest.alias("digest"))
    )


def text_to_media(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, media): each text as a PGM image, padded with 255 to a positive multiple of 576 bytes."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    frames = F.greatest(F.lit(1), F.floor((n + FRAME - 1) / FRAME).cast("int"))
    docs = docs.select(F.col(id_col).alias("id"), raw.alias("raw"), n.alias("n"), (frames * FRAME).alias("size"))
    head = F.concat(F.lit("P5\n# bytes "), F.col("n"), F.lit(f"\n{WIDTH} "), (F.col("size") / WIDTH).cast("int"), F.lit("\n255\n"))
    media = F.concat(head.cast("binary"), F.rpad(F.col("raw"), F.col("size"), F.lit(b"\xff")))
    made = docs.select("id", media.alias("media"))
    return made.select("id", F.sha2("media", 256).alias("digest"), "media")


def read_pgm(media: bytes) -> tuple[int, bytes, int]:
    """(unpadded bytes, samples, width) of an image that ``text_to_media`` made."""
    kind, note, size, depth, samples = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM image of the size that it gives")
    return int(note.removeprefix(b"# bytes ")), samples, width


def image_feature(samples: bytes, width: int) -> str:
    """Mean brightness and a 64-bit average hash over an 8 x 8 grid of the image."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, width)
    rows = np.linspace(0, grid.shape[0], 9).astype(int)
    cells = np.add.reduceat(np.add.reduceat(grid, rows[:-1], 0, dtype=np.int64), np.arange(0, width, width // 8), 1)
    means = cells / (np.diff(rows)[:, None] * (width // 8))
    bits = np.packbits(means > means.mean()).tobytes().hex()
    return f"{grid.sum(dtype=np.int64) / grid.size:.3f}:{bits}"


MEDIA_FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_facts(stored: DataFrame) -> DataFrame:
    """What the stored bytes (digest, media) hold; fails where they don't match their digest."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_buffer().to_pybytes()
                found = hashlib.sha256(media).hexdigest()
                if found != digest:
                    raise ValueError(f"media does not match its digest {digest}")
                n, samples, width = read_pgm(media)
                rows.append((digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), found, image_feature(samples, width)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)] if rows else [pa.array([], t) for t in KINDS],
                NAMES,
            )

    return stored.select("digest", "media").mapInArrow(facts, MEDIA_FACTS)


NAMES = [x.split()[0] for x in MEDIA_FACTS.split(", ")]
KINDS = [pa.int64() if x.endswith("long") else pa.string() for x in MEDIA_FACTS.split(", ")]


def resolve(references: DataFrame, facts: DataFrame) -> DataFrame:
    """References with the facts of their media: one row for each reference, nulls where nothing is stored.

    The facts are narrow and are reduced to one row a digest before the join,
    so payload bytes are not shuffled.  They are a table of their own, so that
    both sides of the join come from exchanges and a hot digest's references
    can be split.
    """
    one = save(facts.groupBy("digest").agg(*[F.max(c).alias(c) for c in NAMES[1:]]), "media-facts")
    return references.join(one, "digest", "left")


def resolve_sequences(sequences: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows (id, items) of ``parse_sequences`` with each media item's ``payload`` from stored (digest, media), in the same order.

    Only media items meet the payloads, which are one row a digest in a table of
    their own, so a digest that many pages share can be split.  A sequence is
    put together again by its row; payload is null where nothing is stored.
    """
    rows = save(sequences.select(F.monotonically_increasing_id().alias("row"), "id", "items"), "sequences")
    one = save(stored.groupBy("digest").agg(F.first("media").alias("payload")), "payloads")
    items = rows.select("row", F.explode("items").alias("item")).select("row", "item.*")
    digest = F.when(F.startswith("ref", F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 64))
    media = items.where("kind = 'media'").withColumn("digest", digest).join(one, "digest", "left").drop("digest")
    every = items.where("kind <> 'media'").unionByName(media, allowMissingColumns=True)
    whole = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("position", "kind", "text", "ref", "caption", "payload"))).alias("resolved"))
    return rows.join(whole, "row", "left").select("id", F.coalesce("resolved", F.array().cast(f"array<struct<{SEQUENCE[13:-2]},payload:binary>>")).alias("items"))


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, refer to it from an HTML page, parse the page and resolve the reference."""
    put = save(text_to_media(docs, id_col, text_col), "media")
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    page = F.concat(
        F.lit('<article><h1>Document '), name, F.lit(f'</h1><figure><img src="{SCHEME}'), F.col("digest"),
        F.lit('" alt=""><figcaption>Text of document '), name, F.lit("</figcaption></figure></article>"),
    )
    references = media_references(parse_sequences(put.select("id", page.alias("html")), "id", "html"))
    return resolve(references, media_facts(put))
