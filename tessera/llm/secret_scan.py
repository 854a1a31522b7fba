"""Secret scans with a recursive decoding worklist.

Every whole text is scanned with the base patterns. Then each layer on the worklist is unwrapped:
lines with percent or Unicode escapes are decoded in place (with a map from decoded to original
code points; a percent sign escaped any number of times is one step), and base64 runs, plain or
compressed, become layers of their own that map to the run. A run that is no text as a whole is
tried again behind each of its slashes, dashes and underscores, as behind a path or a prefix.
Decoded bytes count as text where they are UTF-8 with at most one unprintable character in twenty.
New layers are rescanned and unwrapped in turn until nothing new appears; a digest of each layer
already seen at its place stops cycles and repeats. Spans always refer to the original text.
Compressed layers are read to their end, member by member, and large ones scanned in pieces.

Defined results: null or empty text has no spans; its base digest is that of the empty string.
Repeated rows are scanned row by row. Base counts and digest depend on the base patterns alone.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from codecs import getincrementaldecoder
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# The base patterns and least lengths of the query's contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the leftmost run of 32 or more is a maximal run
LEAST = (8, 16, 32)

#: Bytes that decompressors take and give at once, and characters of unfolded text scanned together.
INPUT = 1 << 16
CHUNK = 1 << 20
PIECE = 1 << 22
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(
    r"(?P<url>(?:%(?:25)*[0-9A-Fa-f]{2})+)"
    r"|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|\\u(?P<four>[0-9A-Fa-f]{4})|\\U(?P<eight>[0-9A-Fa-f]{8})|\\x(?P<two>[0-9A-Fa-f]{2})"
    r"|&#(?:[xX](?P<refhex>[0-9A-Fa-f]{1,6})|(?P<ref>[0-9]{1,7}));"
)
_ESCAPED_BYTE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_SEPARATOR = re.compile(r"[/_-]")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_WRAPPED_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: A line feed after a character that is not base64.
_LINE_END = re.compile(r"[^A-Za-z0-9+/_\r-]\r?\n")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind index) by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST[0]]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST[1]]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


class _Layer:
    """A decoded text and where it comes from.

    From ``starts[i]`` on, characters came from original[a:b] of ``spans[i]`` = (a, b, plain): one by one if
    plain and as a whole otherwise. Maps are composed when a layer is made, so a lookup is one search
    at any depth.
    """

    def __init__(self, text: str, starts: list[int], spans: list[tuple[int, int, bool]]) -> None:
        self.text, self.starts, self.spans = text, starts, spans

    @classmethod
    def whole(cls, text: str) -> _Layer:
        return cls(text, [0], [(0, len(text), True)])

    def origin(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, _, plain = self.spans[i]
        low = a + start - self.starts[i] if plain else a
        a, b, plain = self.spans[j]
        return low, a + end - self.starts[j] if plain else b

    def inside(self, text: str, pieces: list[tuple[int, int, int, bool]]) -> _Layer:
        """A layer made of pieces (at, a, b, plain) of this one's text."""
        starts: list[int] = []
        spans: list[tuple[int, int, bool]] = []
        for at, a, b, plain in pieces:
            if not plain:
                starts.append(at)
                spans.append((*self.origin(a, b), False))
                continue
            i = bisect_right(self.starts, a) - 1
            while a < b:
                until = min(b, self.starts[i + 1]) if i + 1 < len(self.starts) else b
                low, high, same = self.spans[i]
                starts.append(at)
                spans.append((low + a - self.starts[i], low + until - self.starts[i], True) if same else (low, high, False))
                at, a, i = at + until - a, until, i + 1
        return _Layer(text, starts, spans)


def _utf8_pieces(data: bytes) -> Iterator[tuple[str, int]]:
    """Characters of percent-decoded bytes with the number of bytes each took; bad bytes are Latin-1."""
    at = 0
    while at < len(data):
        n = 1 + (data[at] >= 0xC2) + (data[at] >= 0xE0) + (0xF0 <= data[at] <= 0xF4)
        try:
            char = data[at : at + n].decode("utf-8")
        except UnicodeDecodeError:
            char, n = chr(data[at]), 1
        yield char, n
        at += n


def _unescape(layer: _Layer, low: int, high: int) -> _Layer:
    """The layer that layer.text[low:high] is with its escapes decoded."""
    out: list[str] = []
    pieces: list[tuple[int, int, int, bool]] = []
    text, size, at = layer.text, 0, low

    def add(chars: str, a: int, b: int, plain: bool = False) -> None:
        nonlocal size
        if chars:
            out.append(chars)
            pieces.append((size, a, b, plain))
            size += len(chars)

    for m in _ESCAPE.finditer(text, low, high):
        add(text[at : m.start()], at, m.start(), True)
        at = m.end()
        if m["url"]:
            escaped = [*_ESCAPED_BYTE.finditer(text, *m.span())]
            i = 0
            for char, n in _utf8_pieces(bytes(int(x[1], 16) for x in escaped)):
                add(char, escaped[i].start(), escaped[i + n - 1].end())
                i += n
            continue
        code = int(m["ref"]) if m["ref"] else int(m["braced"] or m["four"] or m["eight"] or m["two"] or m["refhex"], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            add(chr(code), *m.span())
        else:
            add(m[0], *m.span(), True)
    add(text[at:high], at, high, True)
    return layer.inside("".join(out), pieces)


def _compression(data: bytes) -> Callable | None:
    """What makes a decompressor for the compression that the first bytes announce."""
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0):
        return partial(zlib.decompressobj, 47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


class _Unfolded:
    """The chunks that compressed bytes unfold to, over all members that follow each other.

    After a run to the end, ``rest`` holds the bytes behind the last member, and ``ended`` tells
    whether a member came to its end.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.rest, self.ended = data, b"", False

    def __iter__(self) -> Iterator[bytes]:
        data, make, at = self.data, _compression(self.data), 0
        self.rest, self.ended = b"", False
        try:
            while make:
                member = make()
                while not member.eof and at < len(data):
                    tail = data[at : at + INPUT]
                    at += len(tail)
                    while True:
                        chunk = member.decompress(tail, CHUNK)
                        if chunk:
                            yield chunk
                        tail = getattr(member, "unconsumed_tail", b"")
                        if member.eof or not (tail or len(chunk) == CHUNK or not getattr(member, "needs_input", True)):
                            break
                if not member.eof:
                    return
                self.ended, at = True, at - len(member.unused_data)
                while at < len(data) and not data[at]:  # padding between members
                    at += 1
                same = _compression(data[at : at + 8])
                if same is None or getattr(same, "func", same) is not getattr(make, "func", make):
                    self.rest = data[at:]
                    return
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
            pass


def _text_pieces(source: Iterable[bytes], cut_short: bool) -> Iterator[str]:
    """UTF-8 text in pieces, or nothing where the bytes are not text; ``source`` is run through twice.

    Pieces end at line feeds that neither a pattern nor wrapped base64 reaches across. cut_short: the
    last character may be incomplete.
    """
    decoder, size, odd, held = getincrementaldecoder("utf-8")(), 0, 0, []
    try:
        for chunk in source:
            part = decoder.decode(chunk)
            size += len(part)
            if not part.isprintable():
                odd += sum(n for c, n in Counter(part).items() if not (c.isprintable() or c in "\t\r\n"))
            held = [*held, part] if size <= PIECE else []
        decoder.decode(b"", not cut_short)
    except UnicodeDecodeError:
        return
    if not size or odd * 20 > size:
        return
    if size <= PIECE:
        yield "".join(held)
        return
    decoder.reset()
    parts, size = [], 0
    for chunk in source:
        part = decoder.decode(chunk)
        parts.append(part)
        size += len(part)
        # A line feed at the start of a part is left alone: what is before it is in another part.
        if size > PIECE and (ends := [*_LINE_END.finditer(part)]):
            at = ends[-1].end()
            yield "".join([*parts[:-1], part[:at]])
            parts, size = [part[at:]], len(part) - at
    yield "".join(parts)


def _texts(data: bytes) -> Iterator[str]:
    """The texts that bytes are or unfold to, whatever the number of compressions around them."""
    work, seen = [data], set()
    while work:
        data = work.pop()
        digest = hashlib.blake2b(data, digest_size=16).digest()
        if digest in seen:
            continue
        seen.add(digest)
        if _compression(data) is None:
            yield from _text_pieces([data], False)
            continue
        unfolded, head = _Unfolded(data), b""
        for chunk in unfolded:
            head += chunk
            if len(head) >= 6:
                break
        if _compression(head):
            work.append(b"".join(unfolded))
        else:
            for _ in unfolded:  # to its end
                pass
            if not unfolded.ended:  # damaged, or text that only begins as if it were compressed
                yield from _text_pieces([data], False)
            yield from _text_pieces(unfolded, not unfolded.ended)
        if unfolded.rest:
            work.append(unfolded.rest)


def _bytes(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return binascii.a2b_base64(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None


def _decoded(run: str) -> Iterator[str]:
    """The texts in a base64 run, plain or compressed."""
    data = _bytes(run)
    if data:
        yield from _texts(data)


def _promising(run: str, at: int) -> bool:
    """Whether what the run gives from ``at`` on begins like text or a compressed stream."""
    head = _bytes(run[at : at + 64])
    if not head:
        return False
    if _compression(head):
        return True
    try:
        text = getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return False
    return sum(not (c.isprintable() or c in "\t\r\n") for c in text) * 20 <= len(text)


def _suffixes(run: str) -> Iterator[tuple[str, int]]:
    """(text, start) for the parts behind a separator that decode where the run as a whole does not."""
    for m in _SEPARATOR.finditer(run):
        at = m.end()
        if len(run) - at >= 16 and _promising(run, at):
            found = False
            for text in _decoded(run[at:]):
                found = True
                yield text, at
            if found:
                return


def _wrapped_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """(run, start, end) of base64 over consecutive lines of one width and a last one that may be shorter."""
    for m in _WRAPPED.finditer(text):
        lines = [x.span() for x in _WRAPPED_LINE.finditer(text, *m.span())]
        at = 0
        while at < len(lines) - 1:
            width, end = lines[at][1] - lines[at][0], at + 1
            while end < len(lines) and lines[end][1] - lines[end][0] == width:
                end += 1
            ends = [end] if end > at + 1 else []
            if end < len(lines) and lines[end][1] - lines[end][0] < width:
                ends.append(end + 1)  # the shorter line may be of the run or begin what follows
            if width >= 16:
                for last in ends:
                    yield "".join(text[a:b] for a, b in lines[at:last]), lines[at][0], lines[last - 1][1]
            at = end


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    """Layers directly inside one."""
    text = layer.text
    if ("%" in text and _PERCENT.search(text)) or "\\" in text or "&#" in text:
        done = -1
        for m in _ESCAPE.finditer(text):
            if m.start() < done:
                continue
            start = text.rfind("\n", 0, m.start()) + 1
            done = text.find("\n", m.end())
            done = len(text) if done < 0 else done
            yield _unescape(layer, start, done)
    for m in _BASE64.finditer(text):
        whole = False
        for inner in _decoded(m[0]):
            whole = True
            yield layer.inside(inner, [(0, *m.span(), False)])
        if not whole:
            for inner, at in _suffixes(m[0]):
                yield layer.inside(inner, [(0, m.start() + at, m.end(), False)])
    for run, start, end in _wrapped_runs(text):
        for inner in _decoded(run):
            yield layer.inside(inner, [(0, start, end, False)])


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """Base spans and those of every layer, mapped to the original text, each once."""
    found, seen = set(base), set()
    work = [_unwrapped(_Layer.whole(text))]  # layers are made when their turn comes
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        mark = (*layer.origin(0, len(layer.text)), hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        found.update((*layer.origin(a, b), kind) for a, b, kind in base_spans(layer.text))
        work.append(_unwrapped(layer))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans) per row of documents."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: list[list[int]] = [[], [], []]
        digests, spans, n = [], [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            for k in range(3):
                counts[k].append(sum(s[2] == k for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            every = all_spans(text, base) if text else []
            spans.append(_joined(every))
            n.append(len(every))
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(rows, run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every found span of the text, encoded ones included, replaced."""
    names, at = docs.columns, docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for a, b, _ in all_spans(text, base_spans(text)):
            if a >= last:
                out += [text[last:a], mark]
            last = max(last, b)
        return "".join([*out, text[last:]])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = list(batch.columns)
        columns[at] = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
