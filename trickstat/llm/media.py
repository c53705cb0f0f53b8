"""Interleaved documents: ordered texts and media references, and payloads that are resolved by digest.

A page's HTML becomes a sequence of items: text runs, and media references (src and caption) at the place
where they stand. Media live in a table of their own, by digest of their payload. resolved() joins references to
what is read from that table, so positions and captions stay with their page whatever the media's size.

stored_texts() makes media of texts: UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as the
samples of an 8-bit grey PNG of width 64.

Nulls: a null text is an empty one (64 zero bytes), a null html has no items, a reference to an unknown digest
has null columns. Equal payloads have one digest, and one row each time they are referred to. A very long text is
worked on by itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .shared import stored, texts

WIDTH = 64
ITEMS = "array<struct<position int, kind string, text string, digest string, caption string>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HIDDEN = {"script", "style", "template", "noscript"}
_MEDIUM = {"picture", "video", "audio"}


def _source(attrs: dict[str, str | None]) -> str | None:
    several = attrs.get("srcset") or attrs.get("data-srcset") or ""
    return attrs.get("src") or attrs.get("data-src") or several.strip().split(",")[0].split(" ")[0] or None


class _Items(HTMLParser):
    """Text runs and media in document order. A figure's caption goes to the media in it that no inner figure captions; a caption
    without media, or without a figure, is text where it stands. What isn't closed ends with its figure or the page.

    A picture, video or audio is one reference: its own source, or a picture's img, else the first source in it; text in it comes
    after it. Text and media in hidden elements don't count. loose: numbers of the hidden and media elements that are taken as if they weren't there;
    items_of() gives those that have no end."""

    def __init__(self, loose: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.loose = loose
        self.number = 0
        self.open: list[tuple[str, int]] = []
        self.hidden = 0
        self.medium: dict | None = None
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def end_caption(self) -> None:
        if self.caption is None:
            return
        if self.figures:
            self.figures[-1]["captions"].append((len(self.items), "".join(self.caption)))
        else:
            self.words += [" ", *self.caption, " "]
        self.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        figure = self.figures.pop()
        text = " ".join(" ".join(t for _, t in figure["captions"]).split())
        if text and figure["media"]:
            done = {id(item) for item in figure["done"]}
            for item in figure["media"]:
                if id(item) not in done:
                    item["caption"] = text
            done = figure["media"]
        else:
            done = figure["done"]
            if text:
                self.items.insert(figure["captions"][0][0], {"kind": "text", "text": text, "digest": None, "caption": None})
        if self.figures:
            self.figures[-1]["media"] += figure["media"]
            self.figures[-1]["done"] += done

    def refer(self, source: str | None, caption: str | None) -> None:
        if not source:
            return
        self.flush()
        self.items.append({"kind": "media", "text": None, "digest": source.removeprefix("sha256:"), "caption": caption or None})
        if self.figures:
            self.figures[-1]["media"].append(self.items[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        if tag in _HIDDEN or tag in _MEDIUM:
            self.number += 1
            if self.number in self.loose:
                if not self.hidden and not self.medium:
                    self.refer(_source(at) if tag in _MEDIUM else None, at.get("alt"))
                return
            self.open.append((tag, self.number))
            if tag in _HIDDEN:
                self.hidden += 1
            elif not self.hidden and not self.medium:
                self.flush()
                self.medium = {"number": self.number, "tag": tag, "best": _source(at), "first": None, "caption": at.get("alt")}
        elif self.hidden:
            return
        elif tag in ("img", "source"):
            if not self.medium:
                self.refer(_source(at), at.get("alt"))
            elif tag == "img" and self.medium["tag"] == "picture" and not self.medium["best"]:
                self.medium["best"], self.medium["caption"] = _source(at), at.get("alt")
            elif not self.medium["first"]:
                self.medium["first"] = _source(at)
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append({"media": [], "done": [], "captions": []})
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []

    def handle_endtag(self, tag: str) -> None:
        names = [t for t, _ in self.open]
        if tag in names:
            at = len(names) - 1 - names[::-1].index(tag)
            ended, self.open = self.open[at:], self.open[:at]
            self.hidden -= sum(t in _HIDDEN for t, _ in ended)
            if self.medium and any(n == self.medium["number"] for _, n in ended):
                inside, self.words = self.words, []
                self.refer(self.medium["best"] or self.medium["first"], self.medium["caption"])
                self.medium, self.words = None, inside
        elif self.hidden:
            return
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)

    def ended(self) -> list[dict]:
        self.close()
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()
        return self.items


def items_of(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    if parser.open:
        # script and style hide what follows, as in browsers; what other elements without an end would hide or take in stays
        parser = _Items(frozenset(n for t, n in parser.open if t not in ("script", "style")))
        parser.feed(html or "")
    return [{"position": i, **item} for i, item in enumerate(parser.ended())]


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, all other columns as they are (but for one named items), with items in place of html."""
    rest = [c for c in pages.columns if c not in (html, "items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))]))
        for batch in batches:
            found = pa.array([items_of(x) for x in batch.column(html).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found], [*rest, "items"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in rest]
    return pages.select(*rest, html).mapInArrow(run, ", ".join([*fields, f"items {ITEMS}"]))


def resolved(items: DataFrame, media: DataFrame) -> DataFrame:
    """A row per media reference: the caller's columns (but for those named here), position, digest, caption, and what media has
    for its digest. media has a row for each digest; a digest that very many refer to is split as any skewed join."""
    own = [c for c in items.columns if c not in ("items", "position", "digest", "caption", *media.columns)]
    each = items.select(*own, F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("item"))
    each = each.select(*own, F.col("item.position").alias("position"), F.col("item.digest").alias("digest"), F.col("item.caption").alias("caption"))
    return each.join(media, "digest", "left")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, in rows of WIDTH."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, 4)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that png() made; any damage is an error."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, shape = 8, [], (0, 0)
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


def stored_texts(docs: DataFrame) -> DataFrame:
    """digest and media of each document's text; written and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch):
                payloads = [padded((text or "").encode()) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([png(p) for p in payloads], pa.binary())], ["digest", "media"])

    return stored(texts(docs).select("text").mapInArrow(run, "digest string, media binary"), "media")


def page_of(text: str) -> tuple[int, str]:
    """Bytes of a text, and a page that has the text in two paragraphs and between them a figure with the text's media."""
    raw = text.encode()
    middle = text.find(" ", len(text) // 2) + 1 or len(text)
    figure = f'<figure><img src="sha256:{hashlib.sha256(padded(raw)).hexdigest()}"><figcaption>{len(raw)} bytes</figcaption></figure>'
    return len(raw), f"<article><p>{escape(text[:middle])}</p>{figure}<p>{escape(text[middle:])}</p></article>"


def text_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and html for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch):
                made = [page_of(text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], ["doc_id", "n_bytes", "html"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, html string")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Per digest what its stored image and the samples read from it show; copies of a digest count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, cell in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                image = cell.as_py()
                payload = samples(image)
                level = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = level[level > 0] / len(payload)
                mean = int((level * np.arange(256)).sum()) / len(payload)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), f"{WIDTH}x{len(payload) // WIDTH};mean={mean:.3f};levels={len(share)};bits={-(share * np.log2(share)).sum() + 0.0:.3f};zeros={level[0]}"))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split(" ")[0] for x in FEATURES.split(", ")])

    seen = media.select("digest", "media").mapInArrow(run, FEATURES)
    names = [c for c in seen.columns if c != "digest"]
    return seen.groupBy("digest").agg(F.min(F.struct(*names)).alias("x")).select("digest", "x.*")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, position, digest, caption and the features of each document's stored text."""
    found = stored(features(stored_texts(docs)), "features")
    return resolved(sequences(text_pages(docs)), found)
