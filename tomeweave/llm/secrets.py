r"""Secret scan over a worklist of decoded layers.

A text is scanned for assignments, access keys and long hex runs. Where it holds escapes
(``%41``, ``\u0041``, ``\x41``, ``&#65;``) they are undone all at once to give a further layer;
base64 that decodes to text, or to zlib or gzip streams of text, gives others. Base64 is looked for
in every unbroken run and in lines of one width taken together, at all four alignments and from
any place of the run on, so that what else stands before or behind it does not hide it. Every
layer goes through the same scan and the same decoders until nothing new comes out: each kind of
step shortens its input, and a text that was reached before from the same place is not read again. A layer keeps,
for each of its characters, the span of the original it came from, so what is found inside is
reported at the place of its encoded form.

Finds of the text itself are ``assign``, ``access`` and ``hex``; finds of a layer carry the steps
that led there, as in ``base64+zlib/assign``, and are dropped where the same kind was found at the
same place with fewer steps.

Defined results: NULL and empty texts have no spans. Texts are read whole. Equal rows give equal
rows; an empty table gives none. Other columns are not read. A compressed layer is read whole, in
chunks that are cut where nothing is open, so that a decompression bomb does not fill a task: of
it no more is held than a chunk and the longest stretch without such a place. A caller may bound
it to ``inflate`` characters.
"""

from __future__ import annotations

import binascii
import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import ship, table

KINDS = ("assign", "access", "hex")
# The contract's patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Every access key, hex run and base64 run of interest lies within one of these.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Lines of nothing but base64, parted by line ends.
LINES = re.compile(r"[A-Za-z0-9+/_-]+={0,2}(?:\r?\n[A-Za-z0-9+/_-]+={0,2})+")
LINE = re.compile(r"([A-Za-z0-9+/_-]+)(={0,2})")
# No find and no run is shorter than 12 characters; printable UTF-8 of that length, and the first bytes of gzip and zlib.
PLAIN = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}"
)
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
STANDARD = str.maketrans("-_", "+/")
# Bytes that are decompressed together, and what may stand before a place where a chunk is cut.
CHUNK = 1 << 20
CLOSED = re.compile(r"[^\x20\"':=]\Z", re.ASCII)
KEY_END = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.IGNORECASE | re.ASCII)
WORDS = ("passw", "secret", "token", "apikey", "api_key")
# Percent signs and backslashes that are themselves escaped come off in the same step.
ESCAPE = re.compile(
    r"((?:%(?:25)*[0-9A-Fa-f]{2})+)|\\+u([0-9A-Fa-f]{4})|\\+x([0-9A-Fa-f]{2})|&(?:amp;)*#([0-9]{1,7}|x[0-9A-Fa-f]{1,6});"
)
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")

SPANS = "doc_id LONG, spans ARRAY<STRUCT<start: LONG, kind: STRING, `end`: LONG, base: BOOLEAN>>, layers LONG"
_ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))),
    ("layers", pa.int64()),
])


def find(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of everything the patterns hold for."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        at = run.start()
        out += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(run[0]) if len(m[0]) >= 20]
        out += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(run[0])]
    return out


class Layer:
    """A text, the steps that led to it, and the original span of each character.

    ``starts`` and ``ends`` are None for the original itself, and ``whole`` is the one span of all
    that was decompressed. ``more`` gives the rest of such a text, piece by piece.
    """

    def __init__(self, text: str, steps: tuple[str, ...] = (), starts=None, ends=None, whole=None, more=None):
        self.text, self.steps, self.starts, self.ends, self.whole, self.more = text, steps, starts, ends, whole, more

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def _next(self, step: str, text: str, starts: list, ends: list) -> Iterator[Layer]:
        """The layer of a decoded text whose characters came from ``starts`` to ``ends`` here."""
        if not text:
            return
        if self.whole is not None:
            yield Layer(text, (*self.steps, step), whole=self.whole)
            return
        starts, last = np.asarray(starts), np.asarray(ends) - 1
        if self.starts is not None:
            starts, last = self.starts[starts], self.ends[last] - 1
        yield Layer(text, (*self.steps, step), starts, last + 1)

    def layers(self, inflate: int | None) -> Iterator[Layer]:
        yield from self._unescaped()
        for run in RUN.finditer(self.text):
            body = run[0].rstrip("=")
            yield from self._decoded(body, np.arange(run.start(), run.start() + len(body)), run.end(), inflate)
        if "\n" in self.text:
            for body, at, end in _wrapped(self.text):
                yield from self._decoded(body, at, end, inflate)

    def _unescaped(self) -> Iterator[Layer]:
        if not ("%" in self.text or "\\" in self.text or "&" in self.text):
            return
        out, starts, ends, steps, at = [], [], [], set(), 0
        for m in ESCAPE.finditer(self.text):
            if m[1]:
                step, pieces = "url", _percent(m[1])
            else:
                code = int(m[2] or m[3], 16) if m[2] or m[3] else _entity(m[4])
                if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                    continue
                step, pieces = ("unicode" if m[4] is None else "entity"), [(chr(code), 0, m.end() - m.start())]
            steps.add(step)
            out.append(self.text[at : m.start()])
            starts += range(at, m.start())
            ends += range(at + 1, m.start() + 1)
            for c, a, b in pieces:
                out.append(c)
                starts.append(m.start() + a)
                ends.append(m.start() + b)
            at = m.end()
        if steps:
            out.append(self.text[at:])
            starts += range(at, len(self.text))
            ends += range(at + 1, len(self.text) + 1)
            yield from self._next("+".join(sorted(steps)), "".join(out), starts, ends)

    def _decoded(self, body: str, at: np.ndarray, end: int, inflate: int | None) -> Iterator[Layer]:
        """What base64 holds whose characters stand ``at`` places of this text, from any of them on."""
        body = body.translate(STANDARD)
        for shift in range(4):
            part = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            past = 0
            for m in PACKED.finditer(data):
                # A payload begins with a character, of which four make three bytes.
                if m.start() < past or m.start() % 3:
                    continue
                rest = _readable(data[m.start() :])
                if rest is None:
                    continue
                yield from self._plain(data, past, m.start(), at[shift:])
                past = len(data) - rest
                step = "gzip" if m[0][0] == 0x1F else "zlib"
                whole = self.span(int(at[shift + m.start() // 3 * 4]), end)
                texts = _texts(data[m.start() : past], inflate)
                first = next(texts, "")
                if first:
                    yield Layer(first, (*self.steps, f"base64+{step}"), whole=whole, more=texts)
            yield from self._plain(data, past, len(data), at[shift:])

    def _plain(self, data: bytes, low: int, high: int, at: np.ndarray) -> Iterator[Layer]:
        """The stretches of text in a part of the bytes."""
        for m in PLAIN.finditer(data, low, high):
            text = m[0].decode()
            sizes = np.array([len(c.encode()) for c in text]) if not text.isascii() else np.ones(len(text), int)
            upto = m.start() + np.cumsum(sizes)
            # Byte b of three comes from characters b and b + 1 of four.
            first, last = upto - sizes, upto - 1
            yield from self._next("base64", text, at[first // 3 * 4 + first % 3], at[last // 3 * 4 + last % 3 + 1] + 1)


def _wrapped(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Lines of equal width, the last of which may be shorter: their characters, where each
    stands, and where the last one ends."""
    for lines in LINES.finditer(text):
        held: list[re.Match] = []
        for line in [*LINE.finditer(text, *lines.span()), None]:
            if line is not None and (not held or (len(line[1]) == len(held[0][1]) and not held[-1][2])):
                held.append(line)
                continue
            # A shorter line ends the block and may also begin another.
            tail = [line] if line is not None and len(line[1]) < len(held[0][1]) and not held[-1][2] else []
            block = held + tail
            if len(block) > 1 and sum(len(x[1]) for x in block) >= 16:
                at = np.concatenate([np.arange(*x.span(1)) for x in block])
                yield "".join(x[1] for x in block), at, block[-1].end()
            held = [line] if line is not None else []


def _inflated(data: bytes) -> Iterator[bytes | int]:
    """The contents of one compressed stream after another, in pieces; then how many bytes are left."""
    first = True
    while PACKED.match(data):
        stream, rest = zlib.decompressobj(47), data
        while not stream.eof:
            try:
                out = stream.decompress(rest, CHUNK)
            except zlib.error:
                if first:
                    raise
                yield len(data)
                return
            rest = stream.unconsumed_tail
            if out:
                yield out
            elif not rest:
                break
        data, first = stream.unused_data, False
    yield len(data)


def _readable(data: bytes) -> int | None:
    """How many bytes follow the streams that the data begin with; None if these are not all text."""
    decoder, left, some = codecs.getincrementaldecoder("utf-8")(), 0, False
    try:
        for piece in _inflated(data):
            if isinstance(piece, int):
                left = piece
            else:
                decoder.decode(piece)
                some = True
    except (zlib.error, UnicodeDecodeError):
        return None
    return left if some else None


def _texts(data: bytes, inflate: int | None) -> Iterator[str]:
    """The decompressed text in pieces that no find and no code goes across."""
    decoder, open_, read = codecs.getincrementaldecoder("utf-8")(), [], 0
    for piece in _inflated(data):
        if isinstance(piece, int):
            break
        text = decoder.decode(piece)
        if inflate is not None:
            text = text[: inflate - read]
        read += len(text)
        cut = _closed(text)
        open_.append(text[:cut] if cut else text)
        if cut:
            yield "".join(open_)
            open_ = [text[cut:]]
        if read == inflate:
            break
    if any(open_):
        yield "".join(open_)


def _closed(text: str) -> int:
    """The last place of a text behind a space at which nothing is open; 0 if there is none."""
    at = text.rfind(" ")
    while at > 10:
        if CLOSED.match(text, at - 1, at) and not KEY_END.search(text, at - 10, at):
            return at + 1
        at = text.rfind(" ", 0, at)
    return 0


def _entity(code: str) -> int:
    return int(code[1:], 16) if code[0] == "x" else int(code)


def _percent(run: str) -> list[tuple[str, int, int]]:
    """Characters of percent-encoded UTF-8 with their spans; other bytes are read as Latin-1."""
    each = [(int(m[1], 16), *m.span()) for m in PERCENT.finditer(run)]
    out, i = [], 0
    while i < len(each):
        byte = each[i][0]
        n = 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
        try:
            c = bytes(e[0] for e in each[i : i + n]).decode()
        except UnicodeDecodeError:
            n, c = 1, chr(byte)
        n = min(n, len(each) - i)
        out.append((c, each[i][1], each[i + n - 1][2]))
        i += n
    return out


def scan_text(text: str, inflate: int | None = None) -> tuple[list[tuple], int]:
    """``(start, kind, end, base)`` of all finds, and how many layers were read."""
    found: dict[tuple, tuple] = {}
    seen: dict[tuple, int] = {}

    def read(todo: list[Layer]) -> int:
        n = 0
        while todo:
            wave: list[Layer] = []
            for layer in todo:
                # The same text from the same place by another way has nothing new.
                key = (hash(layer.text), layer.span(0, len(layer.text)) if layer.text else None)
                again = seen.get(key, len(layer.steps) + 1) <= len(layer.steps)
                if again and layer.more is None:
                    continue
                if not again:
                    seen[key] = len(layer.steps)
                    n += 1
                    for kind, a, b in find(layer.text):
                        span = layer.span(a, b)
                        name = f"{'+'.join(layer.steps)}/{kind}" if layer.steps else kind
                        new = (len(layer.steps), (span[0], name, span[1], not layer.steps))
                        if (kind, *span) not in found or found[(kind, *span)][0] > new[0]:
                            found[(kind, *span)] = new
                    wave.extend(layer.layers(inflate))
                # The rest of what was decompressed is not held: each piece is read to its end.
                for piece in layer.more or ():
                    n += max(0, read([Layer(piece, layer.steps, whole=layer.whole)]) - 1)
            todo = wave
        return n

    layers = read([Layer(text)])
    place = {k: i for i, k in enumerate(KINDS)}
    return sorted((f for _, f in found.values()), key=lambda f: (f[0], place.get(f[1], len(KINDS)), f[1], f[2])), layers


def scan(docs: DataFrame, inflate: int | None = None) -> DataFrame:
    """Each document's finds, in order of start."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "kind", "end", "base")
        for batch in batches:
            spans, read = [], []
            for text in batch.column(1):
                finds, n = scan_text(text.as_py() or "", inflate)
                spans.append([dict(zip(names, f)) for f in finds])
                read.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(spans, _ARROW.field("spans").type), pa.array(read, pa.int64())],
                schema=_ARROW,
            )

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def query(spark, folder: str) -> DataFrame:
    """Contract ``op6``: every document's secrets, those of the text and those inside its layers."""
    found = scan(table(spark, folder, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        held = F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
        return F.size(held).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *map(of_kind, KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "layers",
    )
