"""Problem 8: oversized items in pieces, cut at natural boundaries (content-defined chunking)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import tokens

#: Kinds of boundaries, weakest first; index is the level.
KINDS = ["none", "word", "line", "sentence", "paragraph", "quote", "part", "end"]
WORD, LINE, SENTENCE, PARAGRAPH, QUOTE, PART = range(1, 7)
_PREFIX = re.compile(rb"[ \t]*(?:[A-Z]{0,3}[>|][ \t]?)*")
_MARK = re.compile(rb"--[-=_.:+'()?/,\w]{4,}\s*\Z")
_BLOCK = re.compile(rb"</(?:p|div|blockquote|li|tr|table|h[1-6])>\s*\Z", re.I)
_FULL_STOPS = [b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f"]


def _among(raw: np.ndarray, characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table[raw]


#: Widest character in bytes, less one: how far a position may lie inside a character.
SLACK = 3


def _sentence_ends(raw: np.ndarray) -> np.ndarray:
    """Positions after a full stop and up to three closing marks, if white space follows, and after ideographic full stops."""
    ends = np.flatnonzero(_among(raw[:-1], b".!?")) + 1
    for _ in range(3):
        ends = ends + (_among(raw[np.minimum(ends, len(raw) - 1)], b"\"')]") & (ends < len(raw) - 1))
    found = [ends[_among(raw[ends], b" \t\r\n")]]
    for stop in _FULL_STOPS:
        at = np.flatnonzero(raw == stop[0])
        at = at[at < len(raw) - 3]
        found.append(at[(raw[at + 1] == stop[1]) & (raw[at + 2] == stop[2])] + 3)
    return np.concatenate(found)


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which a unit ends, and the level of each; a position may come more than once."""
    raw = np.frombuffer(data + b"\n\n\n\n", np.uint8)
    size = len(data)
    breaks = np.flatnonzero(raw[:size] == 10)
    starts = np.concatenate([[0], breaks + 1])
    stops = np.append(breaks, size)
    first = raw[starts]
    blank = (first == 10) | ((first == 13) & (raw[starts + 1] == 10))
    depth = np.zeros(len(starts), np.int64)
    level = np.full(len(starts), LINE, np.int8)
    marked = _among(first, b">| \t-")
    for k in (1, 2, 3):  # initials before a quote mark
        marked |= (first >= 65) & (first <= 90) & _among(raw[np.minimum(starts + k, size + 3)], b">|")
    part = np.zeros(len(starts), bool)
    for i in np.flatnonzero(marked).tolist():
        line = data[starts[i] : stops[i]]
        quoted = _PREFIX.match(line).group()
        depth[i] = quoted.count(b">") + quoted.count(b"|")
        blank[i] |= not line[len(quoted) :].strip()
        part[i] = bool(_MARK.match(line))
    closed = np.zeros(len(starts), bool)
    for i in np.flatnonzero((raw[stops - 1] == 62) | (raw[stops - 1] == 13) & (raw[stops - 2] == 62)).tolist():
        closed[i] = bool(_BLOCK.search(data[max(starts[i], stops[i] - 20) : stops[i]]))
    level[1:][(blank[:-1] & ~blank[1:]) | closed[:-1]] = PARAGRAPH
    level[1:][depth[1:] != depth[:-1]] = QUOTE
    level[part] = PART
    if re.match(rb"[!-9;-~]+:", data):
        end = int(np.argmax(blank)) if blank.any() else len(starts) - 1
        level[1 : end + 1] = LINE
        level[min(end + 1, len(starts) - 1)] = PART
    sentences = _sentence_ends(raw[: size + 1])
    places = np.concatenate([starts, sentences])
    kinds = np.concatenate([level, np.full(len(sentences), SENTENCE, np.int8)])
    inside = (places > 0) & (places < size)
    return places[inside], kinds[inside]


def landmarks(ids: np.ndarray, width: int, spacing: int) -> np.ndarray:
    """True at token positions where a rolling hash of the `width` token pairs before falls into one of `spacing` classes."""
    marks = np.zeros(len(ids) + 1, bool)
    if len(ids) > width:
        pairs = ids[1:] * np.int64(0x1E3779B97F4A7C15) + ids[:-1] * np.int64(0x2545F4914F6CDD1D)
        pairs ^= pairs >> np.int64(29)
        pairs *= np.int64(0x3F58476D1CE4E5B9)
        total = np.concatenate([[0], np.cumsum(pairs)])
        h = total[width:] - total[:-width]
        h ^= h >> np.int64(31)
        marks[width + 1 :] = ((h * np.int64(0x14D049BB133111EB) >> np.int64(33)) & np.int64(0x3FFFFFFF)) % spacing == 0
    return marks


def _sync_points(data: bytes) -> np.ndarray:
    """Byte positions between a character and white space after it: there a token always ends, whatever stands around."""
    raw = np.frombuffer(data, np.uint8)
    space = _among(raw, b" \t\r\n\x0b\x0c")
    return np.flatnonzero(space[1:] & ~space[:-1] & (raw[:-1] < 128)) + 1


class Pieces:
    """A tokenized text, and the exact token count of any of its parts."""

    def __init__(self, text: str, path: str):
        self.path, self.data = path, text.encode("utf-8", "replace")
        self.ids = tokens.encode(self.data.decode(), path)
        self.offsets = np.concatenate([[0], np.cumsum(tokens.lengths(path)[self.ids])])
        self.raw = np.frombuffer(self.data + b"\n", np.uint8)
        self.sync = _sync_points(self.data)

    def before(self, at: int, overlap: int) -> int:
        """Where a piece begins that repeats `overlap` tokens before a cut: at a whole character."""
        start = max(0, at - overlap)
        while start and (self.raw[self.offsets[start]] & 0xC0) == 0x80:
            start -= 1
        return start

    def encoded(self, low: int, high: int) -> int:
        return len(tokens.encode(self.data[low:high].decode("utf-8", "replace"), self.path))

    def tokens(self, start: int, end: int) -> int:
        """Tokens of the part as a text of its own: only up to the first and from the last sync point can they differ."""
        low, high = int(self.offsets[start]), int(self.offsets[end])
        a, b = np.searchsorted(self.sync, [low, high], side="left")
        if a == b or self.sync[b - 1] >= high:
            return self.encoded(low, high)
        first, last = int(self.sync[a]), int(self.sync[b - 1])
        inner = np.searchsorted(self.offsets, [first, last])
        return self.encoded(low, first) + int(inner[1] - inner[0]) + self.encoded(last, high)


def cut_points(text: Pieces, limit: int, least: int, overlap: int, spacing: int, width: int, snap: int) -> list[tuple[int, int, int, int]]:
    """(start, cut, level, tokens) of every piece of a text above the limit, in token positions; the last cut is the end.

    From one cut to the next lie at least `least` and at most limit - overlap tokens (a few less, for characters of several
    tokens). In that range the first landmark is taken, or its end if there is none, and moved to the nearest of the
    strongest boundaries near it: sentences within 4 * snap tokens and stronger ones within 8 * snap go before lines and
    fields within snap; else to the nearest boundary in the range, else to the nearest start of a word, else it stays. A cut
    inside a word can change how the word is tokenized: a piece that so comes above the limit is cut earlier, it alone.
    """
    ids, n, offsets, raw = text.ids, len(text.ids), text.offsets, text.raw
    whole = (raw[offsets] & 0xC0) != 0x80
    level = np.zeros(n + 1, np.int8)
    starts = np.flatnonzero(raw[offsets[:-1]] == 32)
    level[starts] = WORD
    places, kinds = boundaries(text.data)
    np.maximum.at(level, np.searchsorted(offsets, places), kinds)
    level[~whole] = 0
    marks = landmarks(ids, width, spacing)
    natural = np.flatnonzero(level > WORD)
    spaces = np.flatnonzero(level == WORD)
    allowed = np.flatnonzero(whole)
    reach = snap * np.array([0, 0, 1, 4, 8, 8, 8, 0])

    def nearest(sorted_places: np.ndarray, low: int, high: int, to: int) -> int | None:
        a, b = np.searchsorted(sorted_places, [low, high + 1])
        if a == b:
            return None
        k = a + np.searchsorted(sorted_places[a:b], to)
        best = [int(sorted_places[j]) for j in (k - 1, k) if a <= j < b]
        return min(best, key=lambda p: (abs(p - to), p))

    def choose(low: int, high: int) -> int:
        hit = np.flatnonzero(marks[low : high + 1])
        to = low + int(hit[0]) if len(hit) else high
        near = natural[np.searchsorted(natural, max(low, to - 8 * snap)) : np.searchsorted(natural, min(high, to + 8 * snap) + 1)]
        near = near[np.abs(near - to) <= reach[level[near]]]
        if len(near):
            return nearest(near[level[near] == level[near].max()], low, high, to)
        found = (nearest(p, low, high, to) for p in (natural, spaces, allowed))
        return next((p for p in found if p is not None), to)  # `to`: bytes that form no characters

    out, at, most = [], 0, limit - overlap - 2 * SLACK
    start = 0
    while True:
        if n - at <= most:
            size = text.tokens(start, n)
            if size <= limit or n - at <= 1:
                return [*out, (start, n, len(KINDS) - 1, size)]
        high = min(at + most, n - 1)
        while True:
            low = min(at + least, high)
            end = choose(low, high)
            size = text.tokens(start, end)
            if size <= limit or high <= at + 1:
                break
            high = max(at + 1, min(end - 1, high - (size - limit)))
        out.append((start, end, int(level[end]), size))
        at, start = end, text.before(end, overlap)


def pieces(text: str, limit: int, least: int, overlap: int, spacing: int, width: int, snap: int, path: str) -> list[tuple]:
    """(piece_no, start_token, end_token, start_char, end_char, n_tokens, repeated_tokens, boundary, text); [] within the limit.

    n_tokens is the count of the piece's own text, at most the limit.
    """
    if len(text.encode("utf-8", "replace")) <= limit:
        return []
    whole = Pieces(text, path)
    if len(whole.ids) <= limit:
        return []
    out, start_char, before = [], 0, 0
    for number, (start, end, kind, n) in enumerate(cut_points(whole, limit, least, overlap, spacing, width, snap)):
        own = whole.data[whole.offsets[before] : whole.offsets[end]].decode("utf-8", "replace")
        repeated = whole.data[whole.offsets[start] : whole.offsets[before]].decode("utf-8", "replace")
        out.append((number, start, end, start_char - len(repeated), start_char + len(own), n, before - start, KINDS[kind], repeated + own))
        start_char += len(own)
        before = end
    return out


SCHEMA = pa.schema(
    [("piece_no", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()),
     ("n_tokens", pa.int64()), ("repeated_tokens", pa.int32()), ("boundary", pa.string()), ("piece", pa.string())]
)


def split_oversized(
    items: DataFrame, ident: str, text: str, limit: int, overlap: int, least: int | None = None, spacing: int | None = None,
    width: int = 16, snap: int = 48, path: str = tokens.VOCABULARY,
) -> DataFrame:
    """(ident, piece_no, start_token, end_token, start_char, end_char, n_tokens, repeated_tokens, boundary, piece): the pieces,
    in order from 0, of every item of more than `limit` tokens.

    A piece has at most `limit` tokens and repeats the last `overlap` tokens of the one before (up to 3 more where these
    would begin inside a character). boundary is the kind of place at which it ends; without the repeated parts the
    pieces are the text. Cuts depend on the content nearby, so an edit alters only neighbouring pieces: see cut_points().

    limit must be at least overlap + 32. Null and empty texts and items within the limit give no rows; null and repeated
    idents are kept as they are, row by row; other columns are ignored; an empty input gives no rows. Nothing is shuffled.
    """
    if limit < overlap + 32:
        raise ValueError("limit must be at least overlap + 32")
    least = least or (limit - overlap) // 2
    spacing = spacing or max(1, (limit - overlap) // 4)
    kind = items.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner, held = [], [], 0
            for i, body in enumerate(batch["text"].to_pylist()):
                own = pieces(body, limit, least, overlap, spacing, width, snap, path) if body else []
                rows += own
                owner += [i] * len(own)
                held += len(body or "")
                if rows and (held > 8_000_000 or i == batch.num_rows - 1):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)]
                    yield pa.RecordBatch.from_arrays([batch["ident"].take(pa.array(owner)), *columns], ["ident", *SCHEMA.names])
                    rows, owner, held = [], [], 0
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)]
                yield pa.RecordBatch.from_arrays([batch["ident"].take(pa.array(owner)), *columns], ["ident", *SCHEMA.names])

    schema = f"ident {kind}, piece_no int, start_token bigint, end_token bigint, start_char bigint, end_char bigint, n_tokens bigint, repeated_tokens int, boundary string, piece string"
    return items.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("ident", ident)
