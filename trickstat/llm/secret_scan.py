"""Secrets in texts, also under nested encodings.

A worklist of layers per document: the text itself, then what URL escapes, Unicode escapes, base64 runs and
compressed bytes in a layer decode to, until nothing new appears. A layer that was seen before at its place (by its
content and where its code points come from) isn't entered again, so cycles end and each copy of a token is found. Every layer is scanned by the same patterns, and what is
found there is mapped back to code points of the outermost text. Base64 that is wrapped over lines is decoded as one; where a
run doesn't begin with its code (after a path, or glued to letters) all four ways to cut it into fours are tried, and what
follows each / _ + or - if it begins as text or compressed bytes do. Compressed bytes (zlib of any window, gzip, bzip2, xz, bare deflate; in
base64, or in URL escapes, letters left bare) are unfolded to their end, all members, in pieces
cut where no pattern can span the cut. Base64 of UTF-16 is read as such. Base64 counts from SHORT characters on if compressed bytes with a header begin
it (a run of zeros can be that short), else from LEAST on: a plain secret takes 16 bytes, and bare deflate isn't looked for in less. Bytes that are no UTF-8 and lone surrogates count as U+FFFD and end nothing but a match.

Nulls and empty texts have no secrets; repeated rows give repeated results; further columns of any name do no harm; very
long texts are scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import slices
from .shared import texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as of [0-9a-f]+, of 16 or more
WORDS = ("passw", "secret", "token", "apikey", "api_key")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: URL escapes with what their writers leave bare between them.
MIXED = re.compile(r"[A-Za-z0-9_.~/-]*(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~/-]*)+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4})+")
ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|(?:\\u|%u)([0-9A-Fa-f]{4})")
SHORT, LEAST = 14, 22
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{14,}={0,2}")
JOINT = re.compile(r"[/_+-]")
LINES = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}")
BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)
#: What xz may take to unfold a stream; one that asks for more counts as damaged.
XZ_BYTES = 1 << 28
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
LONE = re.compile(r"[\ud800-\udfff]")
#: Unfolded bytes are held up to this size; beyond, they are unfolded anew when needed and scanned in pieces of about this size.
PIECE = 1 << 20
#: A text up to its last place that no pattern, nor a wrapped run, can span.
CUT = re.compile(r"""(?s:.*)(?:[^A-Za-z0-9+/_.=\-"'\x20:%\\\r\n]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])|\n\n)""")
HEAD = 10
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_B64 = np.zeros(256, bool)
_B64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n")] = True


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret in one layer, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _escaped(text: str, pattern: re.Pattern, decode) -> tuple[str, list[int], list[int]] | None:
    """text with runs of escapes decoded; for each new code point where it starts and ends in text. None if nothing decodes."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(text):
        plain, places = decode(m[0])
        parts += [text[at : m.start()], plain]
        starts += [*range(at, m.start()), *(m.start() + a for a, _ in places)]
        ends += [*range(at + 1, m.start() + 1), *(m.start() + b for _, b in places)]
        at, changed = m.end(), True
    if not changed:
        return None
    return "".join(parts) + text[at:], [*starts, *range(at, len(text))], [*ends, *range(at + 1, len(text) + 1)]


def _bytes(run: str) -> bytes:
    return bytes.fromhex(run.replace("%", ""))


def _url(run: str) -> tuple[str, list[tuple[int, int]]]:
    plain = _bytes(run).decode(errors="surrogateescape")
    places, at = [], 0
    for c in plain:
        size = 3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode())
        places.append((at, at + size))
        at += size
    return LONE.sub("\ufffd", plain), places


def _unicode(run: str) -> tuple[str, list[tuple[int, int]]]:
    parts = [(int(m[1] or m[2] or m[3], 16), m.start(), m.end(), m[3] is not None) for m in ONE.finditer(run)]
    plain, places, i = [], [], 0
    while i < len(parts):
        code, start, end, unit = parts[i]
        if unit and 0xD800 <= code < 0xDC00 and i + 1 < len(parts) and parts[i + 1][3] and 0xDC00 <= parts[i + 1][0] < 0xE000:  # two halves of one
            code, end, i = 0x10000 + ((code - 0xD800) << 10) + parts[i + 1][0] - 0xDC00, parts[i + 1][2], i + 1
        plain.append(chr(code) if code < 0x110000 else "\ufffd")
        places.append((start, end))
        i += 1
    return LONE.sub("\ufffd", "".join(plain)), places


def _header(data: bytes) -> str | None:
    """Which compressed form begins so."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:3] == b"BZh" and data[3:4].isdigit() and data[4:10] in (b"1AY&SY", b"\x17rE8P\x90"):
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if len(data) > 1 and data[0] & 15 == 8 and data[0] < 0x80 and not data[1] & 0x20 and int.from_bytes(data[:2]) % 31 == 0:
        return "zlib"
    return None


class _Stream:
    """One compressed member, unfolded in pieces."""

    def __init__(self, head: bytes) -> None:
        self.kind = _header(head) or "zlib"
        self.unfold = bz2.BZ2Decompressor() if self.kind == "bzip2" else lzma.LZMADecompressor(memlimit=XZ_BYTES) if self.kind == "xz" else zlib.decompressobj(47)
        self.rest = b""

    def step(self, data: bytes) -> bytes:
        """What some bytes give, PIECE at most; rest is what has to be given again."""
        out = self.unfold.decompress(data, PIECE)
        self.rest = self.unfold.unconsumed_tail if self.kind in ("zlib", "gzip") else b""
        return out

    @property
    def full(self) -> bool:
        """Whether there is more to come without further bytes."""
        return bool(self.rest) if self.kind in ("zlib", "gzip") else not self.unfold.needs_input and not self.unfold.eof

    @property
    def eof(self) -> bool:
        return self.unfold.eof

    @property
    def unused(self) -> bytes:
        return self.unfold.unused_data


def _bare(source: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
    """What a deflate stream without a header unfolds to, in pieces; an error unless it ends where its bytes do."""
    unfold = zlib.decompressobj(-15)
    for data in source():
        while data and not unfold.eof:
            yield unfold.decompress(data, PIECE)
            data = unfold.unconsumed_tail
    yield unfold.flush()
    if not unfold.eof or unfold.unused_data:
        raise zlib.error("no whole stream")


def _members(source: Callable[[], Iterator[bytes]], rest: list[bytes]) -> Iterator[bytes]:
    """What the compressed members in a row unfold to, in pieces; rest gets the bytes after the last of them."""
    rest.clear()
    chunks = (c[i : i + PIECE] for c in source() for i in range(0, len(c), PIECE))
    data, whole = next(chunks, b""), False
    while len(data) < HEAD and (more := next(chunks, None)) is not None:
        data += more
    stream = _Stream(data[:HEAD])
    while True:
        try:
            out = stream.step(data)
        except BROKEN:
            if whole:  # what the members before hold is good
                return
            raise
        if out:
            yield out
        if stream.eof:
            whole, data = True, stream.unused
            while len(data) < HEAD and (more := next(chunks, None)) is not None:
                data += more
            if _header(data[:HEAD]) is None:
                rest += [data, *chunks]
                return
            stream = _Stream(data[:HEAD])
        elif stream.full or len(out) == PIECE:
            data = stream.rest
        elif (data := next(chunks, None)) is None:
            return


def _read(source: Callable[[], Iterator[bytes]]) -> tuple[bytes, bytes, bool, list[bytes] | None] | None:
    """Digest, first bytes, whether all is plain text, and the bytes if they are few. None if there are none or they can't be unfolded."""
    digest, size, head, text, held = hashlib.sha1(), 0, b"", True, []
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for data in source():
            digest.update(data)
            size += len(data)
            head += data[: HEAD - len(head)]
            held = [*held, data] if size <= PIECE else []
            try:
                text = text and not CONTROL.search(decoder.decode(data))
            except UnicodeDecodeError:
                text = False
    except BROKEN:
        return None
    return (digest.digest(), head, text and not decoder.getstate()[0], held if size <= PIECE else None) if size else None


def _wide(head: bytes) -> str | None:
    """The form of UTF-16 that text seems to be in: a mark at its beginning, or each second byte zero."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    odd, even = head[1::2], head[::2]
    return "utf-16-le" if len(head) > 3 and not any(odd) and all(even) else "utf-16-be" if len(head) > 3 and not any(even) and all(odd) else None


def _pieces(source: Callable[[], Iterator[bytes]], form: str = "utf-8") -> Iterator[str]:
    decoder, held, size, limit = codecs.getincrementaldecoder(form)("replace"), [], 0, PIECE
    for data in source():
        held.append(decoder.decode(data))
        size += len(held[-1])
        if size > limit:
            text = "".join(held)
            if m := CUT.match(text):
                yield m[0]
            held = [text[m.end() if m else 0 :]]
            size = len(held[0])
            limit = max(PIECE, 2 * size)
    yield "".join(held) + decoder.decode(b"", True)


def _unfold(data: bytes) -> Iterator[tuple[bytes, Iterator[str]]]:
    """Texts in these bytes, through any number of compressed layers, and in what stands after them: digest and pieces."""
    seen: set[bytes] = set()
    work: list[tuple[Callable[[], Iterator[bytes]], list[bytes]]] = [(partial(iter, [data]), [])]
    while work:
        source, rest = work.pop()
        got = _read(source)
        if after := b"".join(rest).lstrip(b"\0"):
            work.append((partial(iter, [after]), []))
        if got is None or got[0] in seen:
            continue
        digest, head, text, held = got
        seen.add(digest)
        if held is not None:
            source = partial(iter, held)
        if form := _header(head):
            more: list[bytes] = []
            work.append((partial(_members, source, more), more))
            if form != "zlib":  # that header is two bytes which other data may begin with, too
                continue
        yield digest, _pieces(source)
        if form := _wide(head):
            yield hashlib.sha1(digest).digest(), _pieces(source, form)
        if not text:
            work.append((partial(_bare, source), []))


def _base64(body: str) -> bytes:
    """The bytes of whole groups, a last character that gives none left out."""
    try:
        return base64.b64decode(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4))
    except binascii.Error:
        return b""


def _begins_as_text(data: bytes) -> bool:
    try:
        return bool(data) and not CONTROL.search(data[:24].decode())
    except UnicodeDecodeError as error:
        return error.start > 20 and not CONTROL.search(data[: error.start].decode())


def _decoded(run: str) -> Iterator[tuple[int, bytes]]:
    """Where in a run its code may begin, and the bytes from there on."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    cuts = {0: _base64(body)}
    if len(run) >= LEAST:
        yield 0, cuts[0]
        if _begins_as_text(cuts[0]) or _wide(cuts[0][:HEAD]) or _header(cuts[0][:HEAD]) not in (None, "zlib"):
            return
    elif _header(cuts[0][:HEAD]):
        yield 0, cuts[0]
    cuts |= {k: _base64(body[k:]) for k in (1, 2, 3)}
    begins = [(m.end(), cuts[m.end() % 4][m.end() // 4 * 3 :][: max(HEAD, 24)]) for m in JOINT.finditer(run[: len(body)])]
    tried = {at for at, head in begins if _header(head) or (len(body) - at >= LEAST - 2 and (_begins_as_text(head) or _wide(head[:HEAD])))}
    tried |= {k for k in (1, 2, 3) if _header(cuts[k][:HEAD]) or (len(run) >= LEAST and not any(at % 4 == k for at in tried))}
    for at in sorted(tried):
        yield at, cuts[at % 4][at // 4 * 3 :]


def _escaped_bytes(layer: str) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and bytes of compressed data in URL escapes with bare characters: from the beginning of a run, or after a mark in it."""
    for m in MIXED.finditer(layer) if "%" in layer else ():
        begins = {0, *(j.end() for j in re.finditer(r"[/_.~-]", m[0])), *(j.start() for j in URL.finditer(m[0]))}
        for at in sorted(m.start() + b for b in begins):
            if _header(unquote_to_bytes(layer[at : min(at + 3 * HEAD, m.end())])[:HEAD]):
                yield at, m.end(), unquote_to_bytes(layer[at : m.end()])


def _encoded(layer: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and characters of what may be base64: unbroken runs, and runs over lines that are parted by single breaks.
    As words before and after may look like lines of it, blocks of equally long lines are tried also, with a shorter last one
    and, at the beginning, with a line that starts after other text."""
    for m in BASE64.finditer(layer):
        yield m.start(), m.end(), m[0]
    for m in LINES.finditer(layer) if "\n" in layer else ():
        if m.end() - m.start() < LEAST:
            continue
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[^\r\n]+", m[0])]
        width = [len(layer[a:b].rstrip("=")) for a, b in lines]
        n, blocks, i = len(lines), {(0, len(lines)), (1, len(lines))}, 0
        while i < n:
            j = i + 1
            while j < n and width[j] == width[i]:
                j += 1
            for low in {i, 0 if i == 1 else i}:
                blocks |= {(low, j), (low, j + 1 if j < n and width[j] < width[i] else j)}
            i = j
        for low, high in sorted(blocks):
            if high - low > 1 and sum(width[low:high]) >= LEAST:
                yield lines[low][0], lines[high - 1][1], "".join(layer[a:b] for a, b in lines[low:high])


def _outer(place: tuple | None, start: int, end: int) -> tuple[int, int]:
    """Where a range of a layer comes from: the layer is the text itself, or its code points have a place each, or all have one."""
    if place is None:
        return start, end
    first, last = place
    return place if isinstance(first, int) else (first[start], last[end - 1])


def secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Secrets of the text itself, and all with those of decoded layers: (start, end, kind) by start, then kind as in KINDS."""
    base = {(s, e, k) for k, s, e in scan(text)}
    every = set(base)
    seen: set[tuple] = set()
    work: list[tuple[Iterator[str], tuple | None]] = [(iter([text]), None)]
    while work:
        pieces, place = work[-1]
        if (layer := next(pieces, None)) is None:
            work.pop()
            continue
        if place is not None:
            every |= {(*_outer(place, s, e), k) for k, s, e in scan(layer)}
        for marks, pattern, decode in ((("%",), URL, _url), (("\\u", "\\x", "%u"), UNICODE, _unicode)):
            if any(mark in layer for mark in marks) and (got := _escaped(layer, pattern, decode)):
                plain, first, last = got
                if place is None:
                    inner = (first, last)
                else:
                    inner = place if isinstance(place[0], int) else ([place[0][i] for i in first], [place[1][i - 1] for i in last])
                key = tuple(hashlib.sha1(x).digest() for x in (plain.encode("utf-8", "surrogatepass"), np.array(inner).tobytes()))
                if key not in seen:
                    seen.add(key)
                    work.append((iter([plain]), inner))
        for start, end, data in chain(((a + at, b, data) for a, b, run in _encoded(layer) for at, data in _decoded(run)), _escaped_bytes(layer)):
            inner = _outer(place, start, end)
            for digest, plain in _unfold(data):
                if (digest, inner) not in seen:
                    seen.add((digest, inner))
                    work.append((plain, inner))
    by = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=by), sorted(every, key=by)


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> set[int]:
    """Rows with a run of that many true bytes; a run ends where its row does."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    first[inner], last[inner - 1] = mask[inner], mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return set((np.searchsorted(offsets, starts[ends - starts >= least], "right") - 1).tolist())


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _suspects(data: np.ndarray, offsets: np.ndarray, rows: list[str | None]) -> set[int]:
    """Rows that may hold a secret or an encoded layer; the others surely hold none."""
    out = _runs(_HEX[data], offsets, 16) | _runs(_B64[data], offsets, SHORT)
    for i, text in enumerate(rows):
        if text and i not in out and ("AKIA" in text or ("%" in text and URL.search(text)) or "\\u" in text or "\\x" in text or "%u" in text or any(w in (low := text.lower()) for w in WORDS)):
            out.add(i)
    return out


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layered long"


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document the base counts, the base spans and all spans as kind:start:end, comma-joined."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                rows = part.column("text").to_pylist()
                may = _suspects(data, offsets, rows)
                out = []
                for i, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), rows, strict=True)):
                    base, every = secrets(text) if i in may else ([], [])
                    out.append({"doc_id": doc_id, **{f"n_{k}": sum(x[2] == k for x in base) for k in KINDS}, "base_spans": _written(base), "spans": _written(every), "n_layered": len(every) - len(base)})
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return texts(docs).mapInArrow(find, SPANS)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_spans", pa.string()), ("spans", pa.string()), ("n_layered", pa.int64())])


def masked(text: str, mask: str = "[SECRET]") -> str:
    """text with every span replaced; overlapping spans count as one."""
    parts, at, end = [], 0, -1
    for s, e, _ in secrets(text)[1]:
        if s >= end:
            parts += [text[at:s] if end < 0 else text[end:s], mask]
            at = end = e
        end = max(end, e)
    return "".join(parts) + text[max(end, 0) :] if parts else text


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns as they are, with the secrets in text replaced by mask. Null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                rows = part.column(text).to_pylist()
                for i in _suspects(data, offsets, rows):
                    rows[i] = masked(rows[i], mask)
                yield part.set_column(at, part.schema.field(at), pa.array(rows, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
