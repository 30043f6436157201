"""Secret scans with a recursive decoding worklist.

The text is the first layer. Each layer is scanned for secrets and for encoded stretches: percent-encoding, Unicode and
HTML character escapes, base64, and compressed data (gzip, zlib) that base64 or percent-encoding gave, inflated as often as it
is compressed. Bytes that aren't UTF-8 are read one character a byte, so that nothing between them is lost. Each stretch is decoded to a new
layer, which goes on the worklist until nothing new comes up; a layer that was seen before is not taken up again, so cycles
end. A layer knows for each of its characters which characters of the original text it came from, so a span found in any layer is given as a span
of the original text.

What inflates beyond `block_bytes` is never held whole: it is read as a stream, in blocks that overlap by `OVERLAP` bytes, each a layer
of its own. All of an inflated layer stands for its whole stretch, so a secret that lies in a block gives the span that it would give
in the whole. A block waits for the end of an encoded stretch, up to `RUN` times its size; a longer stretch that crosses its end is cut, and
what is encoded there can be missed, as can a single secret longer than the overlap. Of data that are cut off, what can be inflated is
read. Layers come one at a time, depth first.

Escapes of escapes (%2541, \\u005cu0041, &#38;#65;) are undone in one step, however deep, as their layers differ in nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, per_batch, table, texts

BLOCK_BYTES, OVERLAP, STEP, RUN = 4 << 20, 256 << 10, 1 << 18, 2
_ENCODED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\r\n"
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is the run pattern with its least length
UNIT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
#: Percent-encoded gzip or zlib data; bytes that need no encoding stand as they are.
PACKED = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA])|(?:%78|x)\^)(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!$'()*,;:@/+-])*")
ESCAPE = re.compile(
    r"\\(?:u005[cC]|x5[cC])*(?:u\{([0-9A-Fa-f]{1,6})\}|u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))"
    r"|&(?:#38;|#[xX]26;)*(?:#[xX]([0-9A-Fa-f]{1,6});|#([0-9]{1,7});)"
)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over line ends, as MIME and PEM wrap it: full lines and a last one.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
#: How gzip and zlib data begin in base64.
MAGIC = re.compile(r"H4sI|eJ[w-z]|eN[o-r]|eF[4-7]|eA[E-H]")

#: (start, end) in the original of each character of a layer; None for the original itself.
Map = np.ndarray | None


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one layer, kinds by their place in KINDS; leftmost and non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _by_characters(text: str, mapping: Map, pattern: re.Pattern, decode) -> tuple[str, np.ndarray] | None:
    """A layer in which each match is replaced by what it decodes to; other characters stay as they are."""
    parts, starts, ends, at = [], [], [], 0
    plain = mapping if mapping is not None else np.stack([np.arange(len(text)), np.arange(len(text)) + 1], 1)
    pieces = []
    for m in pattern.finditer(text):
        found = decode(m)
        if found is None:
            continue
        new, spans = found  # spans: of each new character, in the match
        parts += [text[at : m.start()], new]
        pieces.append(plain[at : m.start()])
        pieces.append(np.array([(plain[m.start() + a][0], plain[m.start() + b - 1][1]) for a, b in spans], np.int64).reshape(-1, 2))
        at = m.end()
    if not at:
        return None
    parts.append(text[at:])
    pieces.append(plain[at:])
    return "".join(parts), np.concatenate(pieces)


def _percent(m: re.Match):
    units = list(UNIT.finditer(m[0]))
    new, at = _read(bytes([int(x[1], 16) for x in units]))  # several bytes make a character
    ends = [*at.tolist()[1:], len(units)]
    return new, [(units[a].start(), units[b - 1].end()) for a, b in zip(at.tolist(), ends, strict=True)]


def _escape(m: re.Match):
    if m[2]:
        code = 0x10000 + (int(m[2], 16) - 0xD800) * 0x400 + int(m[3], 16) - 0xDC00
    else:
        code = int(m[7]) if m[7] else int(m[1] or m[4] or m[5] or m[6], 16)
    if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
        return None
    return chr(code), [(0, len(m[0]))]


def _packed(raw: bytes) -> bool:
    """Whether bytes begin as gzip or zlib data do."""
    return raw[:2] == b"\x1f\x8b" or len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 < 8 and (raw[0] << 8 | raw[1]) % 31 == 0


class _Large(Exception):
    """Data that inflate beyond a block."""


def _inflate(raw: bytes, most: int) -> bytes | None:
    """What gzip (all members) or zlib data holds, and what follows it; None for other data."""
    out, left = [], most
    while _packed(raw):
        try:
            d = zlib.decompressobj(47)
            part = d.decompress(raw, left)
        except zlib.error:
            break
        if not d.eof:
            if d.unconsumed_tail or len(part) >= left:
                raise _Large
            return b"".join([*out, part]) if out or part else None  # it was cut off: what there is
        out.append(part)
        left -= len(part)
        raw = d.unused_data
        if left <= 0 and raw:
            raise _Large
    return b"".join([*out, raw]) if out else None


def _inflating(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a stream of gzip or zlib data holds, in steps; what follows it as it is."""
    d = zlib.decompressobj(47)
    for c in chunks:
        while c:
            try:
                part = d.decompress(c, STEP)
            except zlib.error:
                yield c
                yield from chunks
                return
            if part:
                yield part
            c = d.unconsumed_tail
            if d.eof:
                c, d = d.unused_data, zlib.decompressobj(47)
                if c and not _packed(c):
                    yield c
                    yield from chunks
                    return


def _streamed(raw: bytes, size: int) -> Iterator[bytes]:
    """Data that inflate beyond `size` bytes, inflated as long as they are compressed: overlapping blocks."""
    chunks: Iterator[bytes] = iter([raw])
    for _ in range(len(raw) // 18 + 1):  # a layer of gzip takes 18 bytes, so only data that hold themselves go on
        head = b""
        for c in chunks:
            head += c
            if len(head) > 64:
                break
        chunks = itertools.chain([head], chunks)
        try:
            zlib.decompressobj(47).decompress(head, 1)
        except zlib.error:
            break
        if not _packed(head):
            break
        chunks = _inflating(chunks)
    held, fresh, most = bytearray(), False, size
    for c in chunks:
        held += c
        fresh = True
        while len(held) >= most:
            goes_on = len(held) - len(held.rstrip(_ENCODED))
            if goes_on > OVERLAP and len(held) < RUN * size:
                most = min(RUN * size, len(held) + STEP)  # the block waits for the end of an encoded stretch
                break
            yield bytes(held)
            del held[: max(1, len(held) - OVERLAP)]
            most, fresh = size, len(held) > OVERLAP
    if fresh and held:
        yield bytes(held)


def _opened(raw: bytes, most: int) -> Iterable[bytes] | None:
    """The bytes inflated as long as they are compressed, in blocks where they are more than `most`; None for data that aren't compressed."""
    found, seen = None, set()
    try:
        while raw and (now := _inflate(raw, most)) is not None and now not in seen:
            seen.add(now)
            found = raw = now
    except _Large:
        return _streamed(raw, most)
    return None if found is None else [found]


def _base64(text: str) -> bytes:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _clean(raw: bytes) -> bool:
    """Whether it is UTF-8 text without control characters other than white space."""
    try:
        return not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", raw.decode())
    except UnicodeDecodeError:
        return False


def _read(raw: bytes) -> tuple[str, np.ndarray]:
    """The bytes as text, and where its characters begin: UTF-8, or one character a byte."""
    try:
        return raw.decode(), np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.arange(len(raw))


def _stretches(text: str):
    """Base64 stretches, each line and lines joined over their ends: (characters, the place of each in the text)."""
    for m in BASE64.finditer(text):
        yield m[0], np.arange(m.start(), m.end())
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            places = np.concatenate([np.arange(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"\S+", m[0])])
            yield "".join(m[0].split()), places


def _starts(body: str, most: int):
    """(start, bytes, whether inflated) of what a stretch decodes to.

    Where the whole isn't text or compressed, what stands before the encoded part may be a path or prefix: all four
    alignments are read, which include those after any '/', '-' or '_', and compressed data may begin anywhere.
    """
    raw = _base64(body)
    packed = _opened(raw, most)
    if packed is not None:
        yield from ((0, x, True) for x in packed)
        return
    yield 0, raw, False
    if _clean(raw):
        return
    for k in (1, 2, 3):
        if other := _base64(body[k:]):
            yield k, other, False
    for m in MAGIC.finditer(body, 1):
        try:
            zlib.decompressobj(47).decompress(_base64(body[m.start() : m.start() + 400]), 1024)
        except zlib.error:  # it only looks like it
            continue
        if (packed := _opened(_base64(body[m.start() :]), most)) is not None:
            yield from ((m.start(), x, True) for x in packed)


def unwrap(text: str, mapping: Map, most: int = BLOCK_BYTES) -> Iterator[tuple[str, np.ndarray]]:
    """The layers right below one: (text, map), one at a time."""
    span = lambda a, b: (a, b) if mapping is None else (mapping[a][0], mapping[b - 1][1])

    def inflated(raw: bytes, a: int, b: int) -> tuple[str, np.ndarray]:  # all of it stands for all of the stretch
        new = _read(raw)[0]
        return new, np.broadcast_to(np.array([span(a, b)], np.int64), (len(new), 2))

    if "%" in text:
        if found := _by_characters(text, mapping, PERCENT, _percent):
            yield found
        for m in PACKED.finditer(text):
            for raw in _opened(unquote_to_bytes(m[0].replace("+", " ")), most) or ():
                yield inflated(raw, m.start(), m.end())
    if ("\\" in text or "&#" in text) and (found := _by_characters(text, mapping, ESCAPE, _escape)):
        yield found
    for body, places in _stretches(text):
        for start, raw, packed in _starts(body, most):
            if not raw:
                continue
            if packed:
                yield inflated(raw, int(places[start]), int(places[-1]) + 1)
                continue
            new, at = _read(raw)  # bytes at to end lie in these of the stretch's characters
            end = np.r_[at[1:], len(raw)]
            first, last = places[start + at * 4 // 3], places[np.minimum(start - (-end * 4 // 3), len(places)) - 1]
            yield new, np.stack([first, last + 1] if mapping is None else [mapping[first, 0], mapping[last, 1]], 1)


def _key(layer: str, mapping: np.ndarray) -> bytes:
    """Which layer it is: its text and where that comes from."""
    places = mapping[:1] if not mapping.strides[0] else mapping
    return hashlib.sha256(b"%d," % len(places) + places.tobytes() + layer.encode("utf-8", "surrogatepass")).digest()


def find_secrets(text: str, most: int = BLOCK_BYTES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans (start, kind, end) in the text, sorted; `all` has the base spans and those of decoded layers."""
    base = scan(text)
    every = set(base)
    seen: set[bytes] = set()
    work = [unwrap(text, None, most)]
    while work:
        found = next(work[-1], None)
        if found is None:
            work.pop()
            continue
        layer, mapping = found
        key = _key(layer, mapping)
        if key in seen:
            continue
        seen.add(key)
        every.update((int(mapping[a][0]), kind, int(mapping[b - 1][1])) for a, kind, b in scan(layer))
        work.append(unwrap(layer, mapping, most))
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents -> doc_id, base and spans as arrays of (start, kind, end): code points, end exclusive.

    One row per row; a null text counts as empty and has no spans; a null doc_id is kept; repeated rows are repeated; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [find_secrets(x.decode(), block_bytes) for x in texts(batch)]
        cols = [[[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in r[i]] for r in rows] for i in (0, 1)]
        return as_batch(["doc_id", "base", "spans"], [pa.int64(), kind, kind], [batch.column("doc_id"), *cols])

    span = "array<struct<start long, kind string, end long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(run), f"doc_id long, base {span}, spans {span}")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
