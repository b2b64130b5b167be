"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Both sides are lower-cased and runs of white space become one blank. An item
is cut into patterns: itself if it is short, else windows of ``WINDOW``
characters, ``STRIDE`` apart; and passages of ``PASSAGE`` characters, ``STEP``
apart. A document has a leak if one of them occurs in it with at most
k = ``RATE`` of its length in edits. The shortest passage that counts is thus
of ``PASSAGE + STEP - 1`` characters: any such part of an item holds a pattern.
Items under ``MIN_CHARS`` characters, too short for the bound below, count if
they occur without an edit and not within a longer word.

A region within k edits of a pattern of m characters shares at least
m - q + 1 - k * q of its q-grams, and these lie on diagonals (position in the
text minus position in the pattern) that differ by at most k. So, per slice
of text:

1. positions whose q-gram is some pattern's are found by a bit table and an
   exact look-up, and windows with fewer such positions than the least bound
   are left;
2. in the rest, shared q-grams are counted per pattern and diagonal band.
   Bands are 2 w wide and overlap by w > k, so that each region's diagonals
   lie within one band;
3. bands that meet their pattern's bound are aligned, within the band, by
   the edit recurrence. No other region is dropped, so the result is exact.

Windows and passages are sought apart, so that the bands of each are as narrow
as its own edits allow. The patterns of all items are broadcast; their size is checked against
``BROADCAST_BYTES``, and a larger benchmark is matched in parts of that size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm.common import codepoints, field, prepare, rolling, slices

Q = 8
WINDOW = 96
STRIDE = 48
PASSAGE = 45
STEP = 12
RATE = 0.08
MIN_CHARS = 40
BROADCAST_BYTES = 1_000_000  # of benchmark text in a set; its patterns take some 150 times as much
TEXT_SLICE = 600_000
_ALIGNED = 512
_TABLE_BITS = 20
_SEPARATOR = np.uint32(0x110000)  # no character


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def windows(text: str, window: int = WINDOW, stride: int = STRIDE, least: int = MIN_CHARS) -> list[str]:
    """One normalised item, or its windows; none if it is shorter than ``least``."""
    if len(text) < least:
        return []
    if len(text) < window + stride:
        return [text]
    starts = [*range(0, len(text) - window, stride), len(text) - window]
    return [text[s:s + window] for s in starts]


def passages(text: str, size: int = PASSAGE, step: int = STEP) -> list[str]:
    """The passages of one normalised item that is longer than ``size``."""
    last = len(text) - size
    return [text[s:s + size] for s in [*range(0, last, step), last]] if last > 0 else []


def cut(text: str) -> list[str]:
    """Patterns of one normalised item."""
    return [*windows(text), *passages(text)]


class Patterns:
    """The patterns of a set of items, by kind."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, q: int = Q):
        self.q = q
        self.ids = list(dict.fromkeys(i for i, _ in items))
        number = {i: n for n, i in enumerate(self.ids)}
        texts = [(number[i], normalised(t)) for i, t in items]
        self.kinds = [_Kind([(i, codepoints(p)) for i, t in texts for p in dict.fromkeys(f(t))], rate, q)
                      for f in (windows, passages)]
        self.kinds.append(_Whole([(i, codepoints(t)) for i, t in texts if 0 < len(t) < MIN_CHARS], q))
        self.reach = max(k.longest + 2 * k.band for k in self.kinds)

    def matches(self, text: np.ndarray) -> list[tuple[int | None, int, int, int]]:
        """``(item, start, end, edits)`` of each verified region: the best alignment's place in ``text``."""
        h = rolling(text, self.q)
        return [(self.ids[k.item[p]], *hit) for k in self.kinds for p, *hit in k.matches(text, h)]


class _Kind:
    """Patterns of like length, indexed by q-gram."""

    def __init__(self, found: list[tuple[int, np.ndarray]], rate: float, q: int):
        self.q = q
        self.item = np.array([i for i, _ in found], np.int64)
        self.codes = [c for _, c in found]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = (self.length * rate).astype(np.int64)
        self.bound = self.length - q + 1 - self.edits * q
        if len(self.bound) and self.bound.min() < 1:
            raise ValueError("q, rate and the shortest pattern leave no q-gram to count")
        self.band = int(self.edits.max(initial=0)) + 1  # w
        self.longest = int(self.length.max(initial=0))
        # By length, to eight characters: the least bound, and the most characters a region's q-grams start in.
        step = self.length // 8
        self.classes = [(int(self.bound[step == x].min()), int((self.length + self.edits)[step == x].max()) - q + 1)
                        for x in np.unique(step)]
        grams = [rolling(c, q) for c in self.codes]
        keys = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.pattern = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.keys, first, self.many = np.unique(keys[order], return_index=True, return_counts=True)
        self.first = first
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def matches(self, text: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(pattern, start, end, edits)`` of each verified region in ``text``, whose q-grams are ``h``."""
        if not len(self.keys):
            return []
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == h[at]
        at, key = at[same], key[same]
        # 1. A position counts if, for patterns of some length, a region's length around it has enough of them.
        mark = np.zeros(len(at) + 1, np.int64)
        for least, reach in self.classes:
            if len(at) >= least:
                starts = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] < reach)
                mark[starts] += 1
                mark[starts + least] -= 1
        near = np.cumsum(mark[:-1]) > 0
        at, key = at[near], key[near]
        if not len(at):
            return []
        # 2. Shared q-grams by pattern and band of diagonals.
        many = self.many[key]
        text_at = np.repeat(at, many)
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.first[key], many) + offset
        pattern, place = self.pattern[entry], self.place[entry]
        diagonal = text_at - place + self.longest  # never negative
        w = self.band
        lane = np.concatenate([diagonal // w, diagonal // w - 1])
        pattern, place = np.tile(pattern, 2), np.tile(place, 2)
        lanes = (len(text) + 2 * self.longest) // w + 3
        group = pattern * lanes + lane + 1
        # a pattern's place counts once
        spot = np.unique(group * (self.longest + 1) + place)
        group, count = np.unique(spot // (self.longest + 1), return_counts=True)
        pattern, lane = np.divmod(group, lanes)
        enough = count >= self.bound[pattern]
        pattern, lane = pattern[enough], lane[enough] - 1
        # 3. Alignment within the band.
        out = []
        for s in range(0, len(pattern), _ALIGNED):
            p = pattern[s:s + _ALIGNED]
            hits = banded([self.codes[x] for x in p], text, lane[s:s + _ALIGNED] * w - self.longest, 2 * w, self.edits[p])
            out += [(x, *hit) for x, hit in zip(p.tolist(), hits) if hit]
        return out


class _Whole:
    """Short items, sought without edits between word boundaries, by the hash of their first characters."""

    def __init__(self, found: list[tuple[int, np.ndarray]], q: int):
        self.item = [i for i, _ in found]
        self.codes = [c for _, c in found]
        self.longest = max(map(len, self.codes), default=0)
        self.band = 0
        self.heads: dict[int, dict[int, list[int]]] = {}
        for p, c in enumerate(self.codes):
            head = c[:q]
            self.heads.setdefault(len(head), {}).setdefault(int(rolling(head, len(head))[0]), []).append(p)
        self.tables = {}
        for n, keys in self.heads.items():
            self.tables[n] = np.zeros(1 << _TABLE_BITS, bool)
            self.tables[n][[k >> (64 - _TABLE_BITS) for k in keys]] = True

    def matches(self, text: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        out = []
        for n, keys in self.heads.items():
            h = rolling(text, n)
            at = np.flatnonzero(self.tables[n][(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            for a, key in zip(at.tolist(), h[at].tolist()):
                for p in keys.get(key, ()):
                    b = a + len(self.codes[p])
                    if np.array_equal(text[a:b], self.codes[p]) and not _within(text, a) and not _within(text, b):
                        out.append((p, a, b, 0))
        return out


def _within(text: np.ndarray, at: int) -> bool:
    """Is the place before ``text[at]`` within a word?"""
    return 0 < at < len(text) and all(
        c < _SEPARATOR and unicodedata.category(chr(c))[0] in "LMN" for c in text[at - 1:at + 1])


def banded(patterns: list[np.ndarray], text: np.ndarray, low: np.ndarray, width: int,
           most: np.ndarray) -> list[tuple[int, int, int] | None]:
    """Best occurrence of each pattern in ``text`` on diagonals ``low`` to ``low + width``, with a margin of its edits.

    ``(start, end, edits)`` with at most ``most`` edits, or None. Any start
    and end in the text are free. All patterns advance together, a character
    at a time.
    """
    n = len(patterns)
    length = np.array([len(p) for p in patterns])
    codes = np.full((n, length.max()), _SEPARATOR)
    for r, p in enumerate(patterns):
        codes[r, :len(p)] = p
    margin = int(most.max())
    lanes = np.arange(width + 2 * margin + 1)
    begin = (low - margin)[:, None] + lanes
    big = int(length.max()) + len(lanes) + 1
    padded = np.concatenate([text, [np.uint32(_SEPARATOR + 1)]])  # met by no pattern character
    cost = np.where((begin < 0) | (begin > len(text)), big, 0)
    first = begin.copy()
    out: list[tuple[int, int, int] | None] = [None] * n
    edge = np.full((n, 1), big)
    none = np.zeros((n, 1), begin.dtype)
    for i in range(codes.shape[1]):
        j = first + i  # text position that lane's diagonal reads for pattern position i
        inside = (j >= 0) & (j < len(text))
        same = padded[np.where(inside, j, len(text))] == codes[:, i:i + 1]
        step = np.where(inside, cost + ~same, big)
        # pattern character left out: from the next diagonal
        up = np.concatenate([cost[:, 1:] + 1, edge], axis=1)
        start = np.where(up < step, np.concatenate([begin[:, 1:], none], axis=1), begin)
        # text character left out: from the lane before, within the row
        ramp = np.minimum(step, up) - lanes
        best = np.minimum.accumulate(ramp, axis=1)
        source = np.maximum.accumulate(np.where(ramp == best, lanes, 0), axis=1)
        begin = np.take_along_axis(start, source, axis=1)
        cost = np.where((j < -1) | (j >= len(text)), big, np.minimum(best + lanes, big))
        for r in np.flatnonzero(length == i + 1):
            k = int(cost[r].argmin())
            if cost[r, k] <= most[r]:
                out[r] = int(begin[r, k]), int(j[r, k]) + 1, int(cost[r, k])
    return out


def _pieces(texts: list[str | None], reach: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Slices of normalised text as ``([(row, its start in the slice)], codes)``.

    Texts are set apart by a separator. A text longer than a slice is cut into
    parts that overlap by ``reach``, which holds any region.
    """
    held: list[tuple[int, int]] = []
    parts: list[np.ndarray] = []
    size = 0
    gap = np.array([_SEPARATOR])
    for r, t in enumerate(texts):
        codes = codepoints(normalised(t))
        for s in range(0, max(1, len(codes)), TEXT_SLICE):
            part = codes[s:s + TEXT_SLICE + reach]
            held.append((r, size))
            parts += [part, gap]
            size += len(part) + 1
            if size >= TEXT_SLICE:
                yield held, np.concatenate(parts)
                held, parts, size = [], [], 0
    if held:
        yield held, np.concatenate(parts)


def leaks_of(texts: list[str | None], patterns: Patterns) -> Iterator[tuple[int, int | None, int, int]]:
    """``(row, item, edits, matched characters)`` of every verified region."""
    for held, codes in _pieces(texts, patterns.reach):
        starts = np.array([s for _, s in held])
        for item, a, b, edits in patterns.matches(codes):
            row = held[int(np.searchsorted(starts, a, side="right")) - 1][0]
            yield row, item, edits, b - a


def _id_order(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


def _pattern_sets(benchmark: DataFrame, item_col: str, text_col: str, **how) -> Iterator[Patterns]:
    """The benchmark's items as sets of patterns of bounded size, read to the driver one set at a time.

    All texts of an item are in one set, so each set gives an item's best occurrence.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).dropna(subset=["t"])
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-size // BROADCAST_BYTES))
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        yield Patterns(sorted({(r.i, r.t) for r in part.toLocalIterator()}, key=lambda x: (_id_order(x[0]), x[1])), **how)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """``(id, item_id, edits, matched_chars)``: the best occurrence of each item in each row that has one.

    Null and empty texts and items have none. Texts of items with a null id
    are one more item, with a null ``item_id``. Repeated rows that leak each have their rows.
    """
    spark = prepare(docs)
    out = None
    schema = T.StructType([field(docs, id_col), T.StructField("item_id", T.LongType()),
                           T.StructField("edits", T.IntegerType()), T.StructField("matched_chars", T.IntegerType())])
    for patterns in _pattern_sets(benchmark, item_col, item_text_col, **how):
        sent = spark.sparkContext.broadcast(patterns)

        def run(batches, sent=sent):
            for batch in batches:
                for a, b in slices(batch, "text", 2_000_000):
                    part = batch.slice(a, b - a)
                    best: dict[tuple[int, int | None], tuple[int, int]] = {}
                    for row, item, edits, n in leaks_of(part.column(1).to_pylist(), sent.value):
                        best[row, item] = min(best.get((row, item), (edits, -n)), (edits, -n))
                    keys = sorted(best, key=lambda k: (k[0], _id_order(k[1])))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([r for r, _ in keys], pa.int64())),
                         pa.array([i for _, i in keys], pa.int64()),
                         pa.array([best[k][0] for k in keys], pa.int32()),
                         pa.array([-best[k][1] for k in keys], pa.int32())], names=schema.names)

        found = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .mapInArrow(run, schema))
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no item of the benchmark occurs.

    Decided row by row, so no text is shuffled and repeated rows share their fate.
    """
    spark = prepare(docs)
    for patterns in _pattern_sets(benchmark, item_col, item_text_col, **how):
        sent = spark.sparkContext.broadcast(patterns)

        def run(batches, sent=sent):
            for batch in batches:
                for a, b in slices(batch, text_col, 2_000_000):
                    part = batch.slice(a, b - a)
                    keep = np.ones(part.num_rows, bool)
                    for row, *_ in leaks_of(part.column(text_col).to_pylist(), sent.value):
                        keep[row] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
