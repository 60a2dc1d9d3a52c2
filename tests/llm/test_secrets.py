"""Secrets in texts and in decoded layers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import quote

import pytest

from tomeweave.llm import secrets
from tomeweave.llm.common import table

HEX = "0123456789abcdef" * 2
ASSIGNS = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_of(text):
    """The contract's patterns, each over the whole text."""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGNS.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def scanned(text, inflate=1 << 20):
    return [f"{kind}:{a}:{b}" for a, kind, b, _ in secrets.scan_text(text, inflate)[0]]


def percent(text):
    return "".join(f"%{b:02X}" for b in text.encode())


@pytest.mark.parametrize("text", [
    "", "token", "token: abc", "TOKEN=abcdef", "my_api-key: x apikey='abcdef' api_key : \"abc-def.g\"", "Secret:secret:secret=123456",
    "ſecret=abcdef toKen=abcdef paſſword=abcdef", "AKIA" + "Z" * 15, "AKIA" + "Z" * 16, "AKIAAKIA" + "9" * 12, "xAKIA" + "A" * 20 + "b",
    HEX[:23], HEX[:24], "G" + HEX + "G", "x" + HEX + "_" + HEX, "password  =  'hunter22'", "passwd\n=abcdef", "é😀 token=abcdef é " + HEX,
    "token=" + HEX + "==", "password=" * 50 + "abcdefg",
])
def test_base_patterns(text):
    assert [s for s in scanned(text) if "/" not in s] == base_of(text)


def test_layers():
    secret = "password: hunter22"
    plain = {
        "url": percent(secret), "twice": quote(percent(secret)), "unicode": "".join(f"\\u{ord(c):04x}" for c in secret),
        "entity": "".join(f"&#{ord(c)};" for c in secret), "escaped": "".join(f"\\x{ord(c):02x}" for c in secret),
        "base64": base64.b64encode(f"my {secret} here".encode()).decode(),
        "zlib": base64.b64encode(zlib.compress(secret.encode())).decode(),
        "gzip": base64.b64encode(gzip.compress(secret.encode(), mtime=0)).decode(),
    }
    for name, code in plain.items():
        text = f"é {code} ü"
        found = [s for s in scanned(text) if s.split(":")[0].endswith("/assign")]
        assert len(found) == 1, name
        a, b = map(int, found[0].split(":")[1:])
        assert 2 <= a < b <= 2 + len(code)
        assert (a, b) == (2, 2 + len(code)) or name == "base64"
    nested = base64.b64encode(percent(base64.b64encode(secret.encode()).decode()).encode()).decode()
    found = [s for s in scanned(nested) if s.endswith(f":0:{len(nested)}") or "/assign" in s]
    assert any(s.startswith("base64+url+base64/assign:") for s in found)


def test_base64_spans_follow_the_bytes():
    inner = "ab token=abcdef é"
    code = base64.b64encode(inner.encode()).decode()
    (span,) = [s for s in scanned("xx " + code) if "/" in s]
    _, a, b = span.split(":")
    assert int(a) == 3 + 4 and 3 + 4 * 15 // 3 <= int(b) <= 3 + 4 * 15 // 3 + 1


def test_cycles_and_bombs_end():
    text = "%25" * 2000 + "41 " + base64.b64encode(b"A" * 30).decode()
    assert secrets.scan_text(text, 1000)[1] < 20
    bomb = base64.b64encode(zlib.compress(b"x" * 5_000_000 + b" token=abcdef")).decode()
    finds, layers = secrets.scan_text(bomb, 10_000)
    assert layers == 2 and finds == []


def test_nothing_is_cut_from_a_compressed_layer():
    rng = random.Random(1)
    for filler in ("x" * 20_000_000, "ab cd, " * 3_000_000, "token " * 500_000, "é\n" * 1_500_000):
        inner = base64.b64encode(b"so password: hunter22 it is").decode()
        code = base64.b64encode(zlib.compress(f"{filler} token=abcdef {filler} {inner}".encode())).decode()
        finds, _ = secrets.scan_text(f"a {code} b")
        # All of it is at the place of the outer code, and of one kind.
        assert finds == [(2, "base64+zlib/assign", 2 + len(code), False)]
        code = base64.b64encode(gzip.compress(f"{filler} {inner}".encode(), mtime=0)).decode()
        assert [f[1] for f in secrets.scan_text(code)[0]] == ["base64+gzip+base64/assign"]
    # Pieces are cut where nothing is open, wherever the ends of the chunks fall.
    for _ in range(20):
        text = "lorem ipsum " * 87_380 + "z" * rng.randrange(30) + " password  =  'hunter22' AKIA" + "Z" * 16 + " " + HEX
        code = base64.b64encode(zlib.compress(text.encode())).decode()
        assert {f[1].split("/")[1] for f in secrets.scan_text(code)[0]} == {"assign", "access", "hex"}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("width", [64, 76, 50])
def test_wrapped_base64(width, end):
    rng = random.Random(width)
    words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10**6)) for _ in range(60))

    def wrapped(data):
        code = base64.b64encode(data).decode()
        return end.join(code[i : i + width] for i in range(0, len(code), width))

    for pack, step in ((zlib.compress, "zlib"), (gzip.compress, "gzip")):
        code = wrapped(pack(f"{words} password: hunter22".encode()))
        assert f"base64+{step}/assign:4:{4 + len(code)}" in scanned(f"xx:{end[-1]}{code}{end}!")
        pem = f"-----BEGIN DATA-----{end}{code}{end}-----END DATA-----"
        assert any(x.startswith(f"base64+{step}/assign") for x in scanned(pem))
    for before in range(width):
        secret = "password=hunter22andmore"
        code = wrapped((" " * before + secret + " " + words).encode())
        a, b = before // 3 * 4 + before % 3, (before + len(secret) - 1) // 3 * 4 + (before + len(secret) - 1) % 3 + 1
        a, b = (x + x // width * len(end) for x in (a, b))
        assert f"base64/assign:{a}:{b + 1}" in scanned(code)


@pytest.mark.parametrize("before", ["/path/", "id_", "//host/", "x", "ab", "abc", "a-b_c/"])
def test_base64_behind_other_characters(before):
    secret = b"my password: hunter22, keep it"
    code = base64.b64encode(secret + b"\xc3\xbf??>>").decode()
    (span,) = [x for x in scanned(before + code) if "/" in x]
    assert span == f"base64/assign:{len(before) + 4}:{len(before) + 28}"
    code = base64.b64encode(zlib.compress(secret)).decode()
    assert f"base64+zlib/assign:{len(before)}:{len(before) + len(code)}" in scanned(before + code)


def test_all_members_of_a_compressed_run():
    parts = gzip.compress(b"nothing here", mtime=0) + gzip.compress(b"token=abcdef", mtime=0)
    code = base64.b64encode(parts).decode()
    assert scanned(code) == [f"base64+gzip/assign:0:{len(code)}"]
    code = base64.b64encode(zlib.compress(b"nothing here") + b" and token=abcdef").decode()
    assert [x.split(":")[0] for x in scanned(code)] == ["base64/assign"]


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    rows = {r["doc_id"]: r for r in secrets.query(spark, small).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        base = base_of(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in rows[i]["spans"].split(",") if s and "/" not in s] == base
        for k in secrets.KINDS:
            assert rows[i][f"n_{k}"] == sum(s.startswith(k + ":") for s in base)


def test_odd_rows(spark):
    rows = [(1, None, "x", 2), (None, "token=abcdef", "x", 2), (2, "", "x", 2), (3, "a " * 100_000 + "token=abcdef", "x", 2), (3, "token=abcdef", "x", 2)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, spans STRING, layers INT")
    got = sorted(((r["doc_id"] or 0), [s["start"] for s in r["spans"]]) for r in secrets.scan(df).collect())
    assert got == [(0, [0]), (1, []), (2, []), (3, [0]), (3, [200_000])]
    assert secrets.scan(df.limit(0)).collect() == []
