"""Secret scan: a worklist of decoded layers, each rescanned, its findings mapped back to the text.

The base patterns run over the text itself. Then layers are unwrapped until nothing new appears: lines with %XX or
\\uXXXX escapes, base64 runs, and compressed data (gzip, zlib) inside them, in any nesting. A layer is known by its
content, its place and the layers it came from stop there, so a layer that decodes to itself ends (cycle detection).
A finding inside a layer is mapped to the code points of the original text that it was decoded from; findings that the
base already has at the same place are not repeated. Their kind names the layers, as in `base64+gzip-assign`.

Bytes are read as UTF-8, or else as one character each, since the patterns are ASCII; ASCII in UTF-16 is read besides.
Base64 that goes on over adjacent lines is joined. Compressed data may have several members.

Null and empty texts have no span. Rows that repeat an id are scanned one by one; other columns are not read. Whole
texts are scanned, and all that compressed data unpacks to: in windows of about `max_unpacked` bytes that end where no
finding can be open, each settled before the next is unpacked, so memory is bounded and output is not. A text is flagged
`truncated` if compressed data ends early or is damaged (what comes before is scanned), or if a stretch without such an
end fills a window.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import per_text

# fixed values: the base patterns
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex")

ESCAPES = {"url": re.compile(r"(?:%[0-9A-Fa-f]{2})+"), "unicode": re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
PACKED = ("H4sI", "eA", "eF", "eJ", "eN")  # base64 of gzip and zlib headers
WIDE = re.compile(rb"\x00?(?:[\t\n\r -~]\x00){7,}[\t\n\r -~]?")  # ASCII in UTF-16, either byte order
BREAK = re.compile(rb"[^A-Za-z0-9+/_.=\"' :%\\\r\n\t\x00-]")  # never inside a finding, an escape or wrapped base64
STEP, OVERLAP = 1 << 18, 1 << 16

SCHEMA = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("layers", pa.int64()), ("truncated", pa.bool_())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping per kind; matches that are too short are dropped."""
    out = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass(frozen=True)
class Layer:
    """Decoded text; piece i of it begins at at[i] and came from source[i]. whole pieces map as one block."""

    text: str
    names: tuple[str, ...]
    at: tuple[int, ...]
    source: tuple[tuple[int, int], ...]
    plain: tuple[bool, ...]

    def original(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, max(start, end - 1)) - 1
        a = self.source[i][0] + (start - self.at[i] if self.plain[i] else 0)
        b = self.source[j][0] + (end - self.at[j]) if self.plain[j] else self.source[j][1]
        return a, b


def text_of_bytes(data: bytes) -> str:
    """UTF-8, or else one character for each byte: the patterns are ASCII."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def unescape(kind: str, run: str) -> str:
    if kind == "url":
        return text_of_bytes(bytes.fromhex(run.replace("%", "")))
    text = run.replace("\\u", "")
    return "".join(chr(int(text[i : i + 4], 16)) for i in range(0, len(text), 4)).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def escaped_lines(layer: Layer, kind: str) -> list[Layer]:
    """A new layer for every line of a layer that holds escapes of a kind."""
    pattern, out, text = ESCAPES[kind], [], layer.text
    done = -1
    for first in pattern.finditer(text):
        if first.start() < done:
            continue
        a = text.rfind("\n", 0, first.start()) + 1
        b = text.find("\n", first.start())
        b = len(text) if b < 0 else b
        done = b
        parts, at, source, plain, size, last = [], [], [], [], 0, a

        def add(piece: str, s: int, e: int, is_plain: bool) -> None:
            nonlocal size
            if piece:
                # a plain piece of a layer that is itself decoded maps as a block, unless that stretch was plain too
                s0, e0 = layer.original(s, e)
                parts.append(piece), at.append(size), source.append((s0, e0)), plain.append(is_plain and e0 - s0 == len(piece))
                size += len(piece)

        for m in pattern.finditer(text, a, b):
            add(text[last : m.start()], last, m.start(), True)
            add(unescape(kind, m[0]), m.start(), m.end(), False)
            last = m.end()
        add(text[last:b], last, b, True)
        if parts:
            out.append(Layer("".join(parts), (*layer.names, kind), tuple(at), tuple(source), tuple(plain)))
    return out


def packed(data: bytes) -> str:
    """gzip, zlib or nothing, by the header."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    return "zlib" if data[:1] == b"\x78" and len(data) > 1 and (data[0] << 8 | data[1]) % 31 == 0 else ""


def pieces(data: bytes) -> Iterator[bytes]:
    return (data[i : i + OVERLAP] for i in range(0, len(data), OVERLAP))


def inflated(source: Iterable[bytes], facts: dict) -> Iterator[bytes]:
    """Unpacked pieces of all members. facts: `read` is where the last member ends, `short` if one is cut or damaged."""
    d, rest, some = None, b"", False
    facts["read"] = 0
    for piece in source:
        data, more = rest + piece, False
        rest = b""
        while data or more:
            if d is None:
                left = data.lstrip(b"\0") if some else data
                if len(left) < 2:
                    rest = data
                    break
                if not packed(left):
                    return
                facts["read"] += len(data) - len(left)
                d, data = zlib.decompressobj(wbits=47), left
            before, size = d.copy(), len(data)
            try:
                got = d.decompress(data, STEP)
            except zlib.error:
                try:  # all that comes before the damage
                    for i in range(size):
                        got = before.decompress(data[i : i + 1])
                        some = some or bool(got)
                        if got:
                            yield got
                        facts["read"] += 1
                except zlib.error:
                    pass
                facts["short"] = facts.get("short", False) or some
                return
            if got:
                some = True
                yield got
            more = len(got) == STEP and not d.eof
            data = d.unused_data if d.eof else d.unconsumed_tail
            facts["read"] += size - len(data)
            d = None if d.eof else d
    if d is not None and some:
        facts["short"] = True


def levels(data: bytes, most: int, facts: dict) -> Iterator[tuple[tuple[str, ...], Iterable[bytes]]]:
    """Names and unpacked pieces of compressed data, of compressed data in it, and so on; ends where a level begins as one before.

    A level of at most `most` bytes is held and the next one unpacked from it, so levels do not nest. A larger level is
    unpacked again as it is read; a chain of such levels is shorter than the text is long in units of `most`.
    """
    names: tuple[str, ...] = ()
    make: Callable[[], Iterable[bytes]] = lambda: pieces(data)
    heads = set()
    while True:
        head = next(iter(make()), b"")
        mark = hashlib.blake2b(head, digest_size=16).digest()
        if not packed(head) or mark in heads:
            return
        heads.add(mark)
        names = (*names, packed(head))
        outer, held, found = make, bytearray(), {}
        small = True
        for piece in inflated(outer(), found):
            held += piece
            if len(held) > most:
                small = False
                break
        if small:
            if found.get("short"):
                facts["short"] = True
            make = (lambda level: lambda: pieces(level))(bytes(held))
            yield names, make()
        else:
            make = (lambda before: lambda: inflated(before(), {}))(outer)
            yield names, inflated(outer(), facts)


def windows(unpacked: Iterable[bytes], most: int, facts: dict) -> Iterator[bytes]:
    """The pieces joined to windows of about `most` bytes that end where no finding can be open.

    If nearly a whole window has no such place, the next one overlaps and facts gets `short`.
    """
    held = bytearray()
    for piece in unpacked:
        if held and len(held) + len(piece) > most:
            end = 0
            for size in (OVERLAP, len(held)):
                m = BREAK.search(bytes(held[-size:])[::-1])
                if m:
                    end = len(held) - m.start()
                    break
            if len(held) - end > most - most // 8:
                facts["short"] = True
                yield bytes(held)
                del held[: -min(OVERLAP, max(1, most // 8))]
            else:
                yield bytes(held[:end])
                del held[:end]
        held += piece
    if held:
        yield bytes(held)


def decoded(run: str) -> bytes:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def block_layers(data: bytes, names: tuple[str, ...], place: tuple[int, int]) -> Iterator[Layer]:
    """What bytes read as, mapped to one place."""
    if data:
        yield Layer(text_of_bytes(data), names, (0,), (place,), (False,))
    if b"\0" in data:
        for m in WIDE.finditer(data):
            yield Layer(m[0].replace(b"\0", b"").decode("ascii"), (*names, "utf16"), (0,), (place,), (False,))


@dataclass(frozen=True)
class Packed:
    """Compressed bytes that are unpacked when their turn comes."""

    data: bytes
    names: tuple[str, ...]
    place: tuple[int, int]


def wrapped_layers(layer: Layer, a: int, b: int) -> Iterator[Layer | Packed]:
    """Layers behind base64 that goes on over adjacent lines, in text[a:b].

    Which line begins it is not known, so all four alignments are decoded; every byte maps to the lines of its letters.
    """
    spans = [m.span() for m in LINE.finditer(layer.text, a, b)]
    joined = "".join(layer.text[x:y] for x, y in spans)
    starts = [0]
    for x, y in spans:
        starts.append(starts[-1] + y - x)
    names = (*layer.names, "base64")
    for skip in range(4):
        data = decoded(joined[skip:])
        at, source = [], []

        def add(lo: int, hi: int, x: int, y: int) -> None:
            if lo < min(hi, len(data)):  # noqa: B023
                at.append(lo), source.append(layer.original(x, y))  # noqa: B023

        for k, (x, y) in enumerate(spans):
            lo, hi = (-(-3 * max(0, c - skip) // 4) for c in (starts[k], starts[k + 1]))
            both = k + 1 < len(spans) and hi > lo and (8 * (hi - 1) + 7) // 6 >= starts[k + 1] - skip
            add(lo, hi - both, x, y)
            if both:
                add(hi - 1, hi, x, spans[k + 1][1])
        if at:
            whole = Layer(data.decode("latin-1"), names, tuple(at), tuple(source), (False,) * len(at))
            yield whole
            if b"\0" in data:
                for m in WIDE.finditer(data):
                    yield Layer(m[0].replace(b"\0", b"").decode("ascii"), (*names, "utf16"), (0,), (whole.original(*m.span()),), (False,))
    for k, (x, _) in enumerate(spans):
        if layer.text.startswith(PACKED, x) and any(inflated([decoded(joined[starts[k] : starts[k] + 4096])], {})):
            data, facts = decoded(joined[starts[k] :]), {}
            for _ in inflated(pieces(data), facts):
                pass
            last = bisect_right(starts, max(starts[k], -(-4 * facts["read"] // 3) + starts[k] - 1), hi=len(spans)) - 1
            yield Packed(data[: facts["read"]], names, layer.original(x, spans[last][1]))


def base64_layers(layer: Layer) -> Iterator[Layer | Packed]:
    """Layers behind base64 runs; compressed ones not yet unpacked."""
    runs = list(BASE64.finditer(layer.text))
    if not runs:
        return
    joins = [m.span() for m in WRAPPED.finditer(layer.text) if BASE64.search(m[0])]
    names = (*layer.names, "base64")
    for m in runs:
        place, data = layer.original(m.start(), m.end()), decoded(m[0])
        k = bisect_right(joins, (m.start(), len(layer.text))) - 1
        alone = k < 0 or joins[k][1] <= m.start()
        if alone and packed(data) and any(inflated(pieces(data), {})):
            yield Packed(data, names, place)
        yield from block_layers(data, names, place)  # also what stands behind compressed data, or only looks like it
    for a, b in joins:
        yield from wrapped_layers(layer, a, b)


def scan_text(text: str | None, max_unpacked: int) -> tuple:
    text = text or ""
    base = base_spans(text)
    spans = {(s, KINDS[k], e): k for s, k, e in base}
    seen: set[bytes] = set()
    layers, facts = 0, {"short": False}

    def unpacked(block: Packed) -> Iterator[Iterator[Layer]]:
        for names, level in levels(block.data, max_unpacked, facts):
            for data in windows(level, max_unpacked, facts):
                yield block_layers(data, (*block.names, *names), block.place)

    def settle(first: Layer) -> None:
        """Depth first on a stack of its own: a window and all that is in it goes before the next one is unpacked."""
        nonlocal layers
        stack: list[deque] = [deque([first])]
        while stack:
            work = stack[-1]
            if not work:
                stack.pop()
                continue
            layer = work.popleft()
            if isinstance(layer, Packed):
                work.appendleft(unpacked(layer))
                continue
            if not isinstance(layer, Layer):  # windows that are still to come
                window = next(layer, None)
                if window is not None:
                    work.appendleft(layer)
                    stack.append(deque(window))
                continue
            mark = hashlib.blake2b(repr((layer.source[0], layer.source[-1])).encode() + layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if layer.names else b""
            if mark in seen:
                continue
            seen.add(mark)
            if layer.names:
                layers += 1
                for s, k, e in base_spans(layer.text):
                    a, b = layer.original(s, e)
                    if (a, KINDS[k], b) not in spans:
                        spans[a, f"{'+'.join(layer.names)}-{KINDS[k]}", b] = len(KINDS)
            for kind, sign in (("url", "%"), ("unicode", "\\u")):
                if sign in layer.text:
                    work.extend(escaped_lines(layer, kind))
            work.extend(base64_layers(layer))

    settle(Layer(text, (), (0,), ((0, len(text)),), (True,)))
    line = lambda keys: ",".join(f"{k}:{s}:{e}" for s, k, e in keys)
    every = sorted(spans, key=lambda x: (x[0], spans[x], x[1], x[2]))
    n = [sum(1 for _, k, _ in base if k == i) for i in range(3)]
    return (*n, line((s, KINDS[k], e) for s, k, e in base), line(every), layers, facts["short"])


def secrets(docs: DataFrame, text_col: str = "text", max_unpacked: int = 64 << 20) -> DataFrame:
    """(row, scan): counts of the base kinds, base and all spans as kind:start:end, decoded layers, truncated."""
    return per_text(docs, text_col, SCHEMA, lambda: lambda texts: [scan_text(t, max_unpacked) for t in texts])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and truncated."""
    out = secrets(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "scan.n_assign", "scan.n_access", "scan.n_hex", F.sha2("scan.base", 256).alias("base_sha256"), "scan.spans", "scan.truncated")
