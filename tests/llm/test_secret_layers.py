"""Layers as standard encoders make them, where they stand, and base spans against plain patterns."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import os
import random
import re
import zlib
from urllib.parse import quote, quote_plus

import pytest

from trickstat.llm import secret_scan

SECRET = b"password = hunter2hunter2"


def b64(data, safe=False):
    return (base64.urlsafe_b64encode if safe else base64.b64encode)(data).decode()


def deflated(data, window):
    made = zlib.compressobj(9, zlib.DEFLATED, window)
    return made.compress(data) + made.flush()


CASES = [
    ("https://example.org/path/", b64(SECRET), "assign"),
    ("x", b64(SECRET), "assign"),
    ("", quote(zlib.compress(SECRET)), "assign"),
    ("/a/b/", quote(zlib.compress(SECRET)), "assign"),
    ("", quote_plus(gzip.compress(SECRET)), "assign"),
    ("", b64(bz2.compress(SECRET)), "assign"),
    ("", b64(lzma.compress(SECRET)), "assign"),
    ("", b64(deflated(SECRET, 12)), "assign"),
    ("ab", b64(gzip.compress(SECRET)), "assign"),
    ("https://example.org/v1/", b64(bz2.compress(SECRET), True), "assign"),
    ("", b64(zlib.compress(b"0" * 64)), "hex"),
    ("", "".join(f"\\u{{{c:x}}}" for c in SECRET), "assign"),
    ("", "".join(f"\\x{c:02X}" for c in SECRET), "assign"),
    ("", "".join(f"%u{c:04x}" for c in SECRET), "assign"),
    ("", b64(SECRET.decode().encode("utf-16-le")), "assign"),
    ("", b64(SECRET.decode().encode("utf-16-be")), "assign"),
    ("", b64(SECRET.decode().encode("utf-16")), "assign"),
]


@pytest.mark.parametrize(("before", "code", "kind"), CASES)
def test_layers_of_standard_encoders(before, code, kind):
    for head, tail in (("é: ", " after"), ("", ""), ('("', '")')):
        text = head + before + code + tail
        span = (len(head + before), len(head + before + code), kind)
        assert span in secret_scan.secrets(text)[1]
        assert "[SECRET]" in secret_scan.masked(text) and secret_scan.secrets(secret_scan.masked(text))[1] == []


def test_pairs_of_code_units_and_wide_code_points():
    plain, places = secret_scan._unicode("\\ud83d\\ude00\\u{1F600}\\x41%u0042\\ud800\\u{999999}")
    assert plain == "😀😀AB��" and places == [(0, 12), (12, 21), (21, 25), (25, 31), (31, 37), (37, 47)]


def test_any_nesting_of_standard_encoders():
    rnd = random.Random(5)
    kinds = [lambda d: b64(d).encode(), lambda d: b64(d, True).encode(), lambda d: quote(d, safe="").encode(), lambda d: quote(zlib.compress(d), safe="").encode(), lambda d: b64(gzip.compress(d)).encode(), lambda d: b64(bz2.compress(d)).encode(), lambda d: b64(lzma.compress(d)).encode(), lambda d: b64(deflated(d, 10)).encode(), lambda d: b64(d.decode().encode("utf-16")).encode()]
    for _ in range(150):
        data = SECRET
        for _ in range(rnd.randint(1, 3)):
            data = rnd.choice(kinds)(data)
        before = rnd.choice(["x ", "https://example.org/some/path/", '{"v":"', ""])
        text = f"{before}{data.decode()} end"
        assert any(k == "assign" and s >= len(before) - 1 for s, _, k in secret_scan.secrets(text)[1]), text
        assert secret_scan.secrets(secret_scan.masked(text))[1] == []


def test_words_are_no_layers():
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("abcdefghijklmnoprstuvwxyzABCéñ/_-") for _ in range(rnd.randint(1, 60))) for _ in range(3000))
    assert secret_scan.secrets(text) == ([], [])
    assert secret_scan.secrets(b64(rnd.randbytes(200_000)))[1] == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_base_spans_of_whole_documents(spark):
    """The contract's patterns, as they are written there."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, t) for i, t in enumerate(["Token='abcdefghijklmn", "ſecret = abcdefghijkl", "toKen = abcdefghijkl", "AKIA" + "Z" * 14 + "AKIA" + "9" * 13, "0123456789abcdef" * 3 + "G", "api_key  :  \"" + "k" * 12, "password=" + "p" * 11])]
    rows = [*((r.doc_id, r.text) for r in df.collect()), *extra]
    got = {r.doc_id: r for r in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        text = text or ""
        want = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        want.sort()
        assert got[i].base_spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert set(got[i].base_spans.split(",")) <= set(got[i].spans.split(","))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[3] == k for w in want) for k in ("assign", "access", "hex"))
