"""Secrets in texts, also behind nested encodings."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import table, texts

# The kinds of secret, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST, HEX_RUN = 6, 20, b"x" * 24

URL_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")
#: The two halves of a surrogate pair are one escape.
ESCAPE = re.compile(r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_RUN = b"x" * 16
#: Base64 wrapped in lines of at least 16 characters, the last one perhaps shorter.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*+\r?\n[\x20\t]*+)++[A-Za-z0-9+/_-]++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
UNDECODABLE = re.compile("[\udc80-\udcff]")
BLANKS = re.compile(rb"\x20{2,}")
BREAKS = (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")
#: Bytes of a compressed layer that are unfolded at a time.
PIECE = 1 << 22


def _marks(alphabet: str) -> bytes:
    return bytes(120 if chr(i) in alphabet else 32 for i in range(256))


HEX_MARKS = _marks("0123456789abcdef")
BASE64_MARKS = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the secrets that stand in the text itself, unsorted.

    Searches for fixed bytes decide first which patterns can match at all.
    """
    spans = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if HEX_RUN in raw.translate(HEX_MARKS):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


class Whole:
    """One stretch as the place of every character of a layer."""

    def __init__(self, span: tuple[int, int]):
        self.all = span

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.all

    def through(self, above):
        return Whole(above.span(*self.all))


class Places:
    """Where each byte or character of a layer stands in the one above: its start and its end."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])

    def through(self, above):
        if isinstance(above, Whole):
            return above
        return Places(above.starts[self.starts], above.ends[self.ends - 1])


def _lengths(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8; an undecodable byte is one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return np.where((codes >= 0xDC80) & (codes <= 0xDCFF), 1, size)


def _unescape(token: str, at: int, pattern: re.Pattern):
    """The bytes of the token with its escapes undone, and where each of them stood."""
    data, starts, ends = bytearray(), array("q"), array("q")
    i = 0
    for m in [*pattern.finditer(token), None]:
        stop = m.start() if m else len(token)
        if stop > i:
            plain = token[i:stop]
            data += plain.encode("utf-8", "surrogatepass")
            where = range(at + i, at + stop)
            if not plain.isascii():
                size = [len(c.encode("utf-8", "surrogatepass")) for c in plain]
                where = [x for x, n in zip(where, size, strict=True) for _ in range(n)]
            starts.extend(where)
            ends.extend([x + 1 for x in where])
        if m:
            units = m[0].replace("\\u", "").replace("\\x", "").replace("%", "")
            if pattern is URL_ESCAPE:
                char = bytes.fromhex(units)
            else:
                char = bytes.fromhex(units.zfill(4)).decode("utf-16-be", "replace").encode()
            data += char
            starts.extend([at + m.start()] * len(char))
            ends.extend([at + m.end()] * len(char))
            i = m.end()
    return bytes(data), Places(np.frombuffer(starts, np.int64), np.frombuffer(ends, np.int64))


def _as_text(data: bytes, places):
    """A layer from decoded bytes; each byte that isn't UTF-8 becomes a separator in its place."""
    if not data:
        return None
    if data.isascii():
        return data.decode(), places
    text = data.decode("utf-8", "surrogateescape")
    if isinstance(places, Places):
        size = _lengths(text)
        last = np.cumsum(size) - 1
        places = Places(places.starts[last - size + 1], places.ends[last])
    return UNDECODABLE.sub("\ufffd", text), places


def _token_start(data: bytes, end: int) -> int:
    """Where the stretch without white space begins that ends at ``end``."""
    for low in (max(0, end - 4096), 0):
        found = max(data.rfind(c, low, end) for c in BREAKS)
        if found >= 0 or not low:
            return found + 1
    return 0


def _open_run(data: bytes) -> int:
    """Where the stretch begins that more bytes could go on: the last one without white space, and lines of base64 before it."""
    start = _token_start(data, len(data))
    while start:
        end = start
        while end and data[end - 1 : end] in BREAKS:
            end -= 1
        line = _token_start(data, end)
        if b"\n" not in data[end:start] or end - line < len(BASE64_RUN) or data[line:end].translate(BASE64_MARKS) != b"x" * (end - line):
            break
        start = line
    return start


def _unfold(data: bytes):
    """Pieces of what a gzip or zlib stream unfolds to, all its members; returns whether one came to its end.

    All up to 2 * PIECE bytes of a member is one piece; further ones begin with the last PIECE bytes
    of the one before, in which runs of blanks are made one blank, as no pattern tells these apart. A piece never ends
    within a stretch of over PIECE bytes without white space, or of lines of base64: it grows until that ends.
    """
    for wbits in (31, 15):
        rest, tail, ended, sound = data, b"", False, True
        while rest and sound:
            unpack = zlib.decompressobj(wbits)
            grown, due = tail, len(tail) + (PIECE if tail else 2 * PIECE)
            while not unpack.eof:
                try:
                    out = unpack.decompress(rest, PIECE)
                except zlib.error:
                    sound = False
                    break
                rest = unpack.unconsumed_tail
                grown += out
                if not out and not rest:
                    break
                if len(grown) < due or unpack.eof:
                    continue
                if len(grown) - _open_run(grown) > PIECE:
                    due = 2 * len(grown)  # looked at again when it has doubled
                    continue
                yield grown
                tail = grown = BLANKS.sub(b" ", grown)[-PIECE:]
                due = len(tail) + PIECE
            if grown is not tail and grown:
                yield grown
                tail = BLANKS.sub(b" ", grown)[-PIECE:]
            if not unpack.eof:
                break
            rest, ended = unpack.unused_data, True
        if ended:
            return True
    return False


def _from_base64(run: str, where: np.ndarray):
    """Layers of base64 characters that stand at ``where``."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78":
        span = Whole((int(where[0]), int(where[-1]) + 1))
        pieces = _unfold(data)
        while True:
            try:
                yield _as_text(next(pieces), span)
            except StopIteration as end:
                if end.value:
                    return
                break
    i = np.arange(len(data))
    yield _as_text(data, Places(where[i * 4 // 3], where[np.minimum(len(where) - 1, (i + 1) * 4 // 3)] + 1))


def _blocks(lines: list[re.Match]):
    """All lines, and besides each row of lines of one length with the shorter line that ends it."""
    yield lines
    size = [len(x[0]) for x in lines]
    start = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or size[i] != size[start]:
            stop = i + 1 if i < len(lines) and size[i] < size[start] else i
            if stop - start > 1 and stop - start < len(lines):
                yield lines[start:stop]
            start = i


def layers_of(text: str, raw: bytes):
    """What the encoded stretches of a text decode to: (text, place of each character in this one)."""
    for pattern, there in ((URL_ESCAPE, b"%" in raw), (ESCAPE, b"\\u" in raw or b"\\x" in raw)):
        if there and pattern.search(text):
            for m in re.finditer(r"\S+", text):
                if pattern.search(m[0]):
                    yield _as_text(*_unescape(m[0], m.start(), pattern))
    if BASE64_RUN in raw.translate(BASE64_MARKS):
        for m in BASE64.finditer(text):
            yield from _from_base64(m[0], np.arange(m.start(), m.end()))
        if b"\n" in raw:
            for m in WRAPPED.finditer(text):
                for lines in _blocks(list(LINE.finditer(text, m.start(), m.end()))):
                    yield from _from_base64("".join(x[0] for x in lines), np.concatenate([np.arange(*x.span()) for x in lines]))


def scan(text: str | None) -> tuple[list, list]:
    """Base spans and all spans of a text, each (start, kind's number, end), sorted.

    A worklist holds layers still to be searched. Each layer is scanned like the text; its spans
    are mapped back, through every layer above, to the stretch of the text that encodes them. A
    layer equal to one already seen at the same place isn't entered again, so the list runs dry.
    """
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    base = sorted(base_spans(text, raw))
    every = set(base)
    work = [(layers_of(text, raw), None)]
    seen = set()
    while work:
        layers, above = work[-1]
        try:
            found = next(layers)
        except StopIteration:
            work.pop()
            continue
        if found is None:
            continue
        layer, places = found
        if above is not None:
            places = places.through(above)
        data = layer.encode("utf-8", "surrogatepass")
        key = (hashlib.blake2b(data, digest_size=16).digest(), places.span(0, len(layer)))
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in base_spans(layer, data):
            start, end = places.span(start, end)
            every.add((start, kind, end))
        work.append((layers_of(layer, data), places))
    return base, sorted(every)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@F.arrow_udf(SPANS)
def find_secrets(text: pa.Array) -> pa.Array:
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
    rows = [{"base": named(b), "spans": named(s)} for b, s in map(scan, texts(text))]
    return pa.array(rows, pa.struct([("base", ARROW_SPANS), ("spans", ARROW_SPANS)]))


@F.arrow_udf(T.StringType())
def redact(text: pa.Array) -> pa.Array:
    out = []
    for t in texts(text):
        parts, at = [], 0
        for start, kind, end in scan(t)[1]:
            if end > at:
                if start >= at:
                    parts += [t[at:start], f"[{KINDS[kind]}]"]
                at = end
        out.append("".join([*parts, t[at:]]) if parts else t)
    return pa.array(out, pa.string())


def secrets(docs: DataFrame) -> DataFrame:
    """The secrets of every document: doc_id, base and spans (arrays of kind, start, end).

    ``base`` holds what the patterns find in the text itself, ``spans`` also what they find in its
    decoded layers (percent escapes, \\u and \\x escapes, base64, also in lines of 16 characters or
    more, gzip and zlib in base64), at the stretch of text that encodes it. A compressed layer of
    over 2 * PIECE bytes is searched in overlapping pieces, none of which ends within a long stretch without white
    space or within lines of base64, so no encoded stretch is cut. Positions count code points. Null and empty texts
    have none; repeated rows are scanned one by one; an empty table gives an empty one; other columns are not read.
    """
    return docs.select("doc_id", find_secrets("text").alias("s")).select("doc_id", "s.base", "s.spans")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by its kind in brackets, n_chars counted anew.

    Null and empty texts stay as they are, repeated rows are redacted one by one, an empty table stays empty; of other columns only
    n_chars changes, where there is one.
    """
    cleaned = docs.withColumn("text", redact("text"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_spans(spark, sf_dir):
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
