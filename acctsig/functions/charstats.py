"""Per-character statistics of each post in one vectorised pass.

Counting letters, capitals, whitespace tokens, emoji and single characters
needs one regex pass per statistic on the JVM, and every Java regex call
decodes the whole text again. Here a batch of posts arrives as one Arrow
column, is decoded once to code points (numpy ``uint32``), and every
statistic is a table lookup plus a segmented sum. The lookup tables are
built from Python's own ``str`` predicates (``isalpha``, ``isupper``,
``islower``, ``isspace``), so the counts have exactly the original
semantics, including ``str.split()`` tokens.

Spark runs it as an Arrow-batched pandas UDF inside the tasks of the
per-post projection: no shuffle, no driver work, bounded batch memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.functions import patterns as P

FIELDS = ["char_len", "alpha", "upper", "words", "emoji", "excl", "quest", "newline",
          "mid_caps_tokens", "exotic", "word_hit"]
_N = 0x110000
BITS = ["alpha", "upper", "lower", "space", "emoji", "exotic", "word"]
_TABLES: dict[str, np.ndarray] = {}
# Characters whose lower case has one of text's exotic folds in it.
EXOTIC = "\u017f\u0131\u0307\u0130"
# Literals with these are not sought here: their case depends on what is beside them.
_UNSURE = set("\u03c3\u03c2\u0307")
PER_LONG = 62  # literals of a long
_COMMON = set("etaoinsrhldcu ")  # letters that most 4-grams consist of
_MIX = 0x9E3779B1


def _ranges(pattern: str) -> list[tuple[int, int]]:
    """Code-point ranges of a one-class pattern such as the emoji pattern."""
    out = []
    for a, b in re.findall(r"\\[uU]([0-9A-Fa-f]+)-\\[uU]([0-9A-Fa-f]+)", pattern):
        out.append((int(a, 16), int(b, 16)))
    return out


def tables() -> dict[str, np.ndarray]:
    """Per-code-point truth tables (built once per Python worker)."""
    if not _TABLES:
        some = 0x40000  # planes 0 to 3; letters, capitals and blanks are in these
        chars = [chr(i) for i in range(some)]
        for name, pred in (("alpha", str.isalpha), ("upper", str.isupper), ("lower", str.islower),
                           ("space", str.isspace), ("word", str.isalnum)):
            _TABLES[name] = np.zeros(_N, dtype=bool)
            _TABLES[name][:some] = np.fromiter(map(pred, chars), dtype=bool, count=some)
        _TABLES["word"][ord("_")] = True
        for name in ("emoji", "exotic"):
            _TABLES[name] = np.zeros(_N, dtype=bool)
        for a, b in _ranges(P.EMOJI_PATTERN):
            _TABLES["emoji"][a:b + 1] = True
        _TABLES["exotic"][[ord(c) for c in EXOTIC]] = True
        # all of them in one byte, so that a character is looked up once
        _TABLES["bits"] = sum((_TABLES[n].astype(np.uint8) << i for i, n in enumerate(BITS)), np.zeros(_N, dtype=np.uint8))
        fold = np.arange(_N, dtype=np.uint32)
        fold[:some] = np.fromiter((ord(c.lower()[0]) for c in chars), dtype=np.uint32, count=some)
        _TABLES["fold"] = fold
    return _TABLES


class Literals:
    """Which of some lower-case literals each text has, lower-cased, in one pass for all of them.

    Every position's 4-gram is hashed and looked up, and only where a literal's own 4-gram may
    lie its characters are compared. Shorter literals are sought by their least common character.
    """

    def __init__(self, literals: tuple[str, ...]):
        self.short, self.long = [], []
        self.longs = -(-len(literals) // PER_LONG)
        for i, k in enumerate(literals):
            codes = [ord(c) for c in k]
            rare = [c not in _COMMON for c in k]
            if len(k) < 4:
                self.short.append((i, codes, rare.index(True) if any(rare) else 0))
            else:
                at = max(range(len(k) - 3), key=lambda j: sum(rare[j:j + 4]))
                self.long.append((i, codes, at, int(self._hash(np.array(codes[at:at + 4], dtype=np.uint32))[0])))
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[[h >> 16 for *_, h in self.long]] = True

    @staticmethod
    def _hash(low: np.ndarray) -> np.ndarray:
        mix = np.uint32(_MIX)
        h = low[:-3] * mix
        for j, end in ((1, -2), (2, -1), (3, None)):
            h += low[j:end]
            h *= mix
        return h

    def masks(self, low: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Per text the literals found, ``PER_LONG`` a number; ``low``: the texts' code points, folded."""
        out = np.zeros((self.longs, len(ends)), dtype=np.int64)

        def mark(i, codes, at):
            at = at[(at >= 0) & (at + len(codes) <= len(low))]
            for j, c in enumerate(codes):
                at = at[low[at + j] == c]
            post = np.searchsorted(ends, at, side="right")
            out[i // PER_LONG, post[at + len(codes) <= ends[post]]] |= 1 << (i % PER_LONG)

        if self.long and len(low) > 3:
            h = self._hash(low)
            at = np.flatnonzero(self.table[h >> np.uint32(16)])
            h = h[at]
            order = np.argsort(h, kind="stable")
            at, h = at[order], h[order]
            for i, codes, offset, mine in self.long:
                a, b = np.searchsorted(h, np.array([mine, mine + 1], dtype=np.uint64))
                mark(i, codes, at[a:b] - offset)
        for i, codes, offset in self.short:
            mark(i, codes, np.flatnonzero(low == codes[offset]) - offset)
        return out


def _word_key(word: str) -> int:
    return sum(ord(c) << (8 * j) for j, c in enumerate(word))


def word_hits(low: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray,
              keys: np.ndarray) -> np.ndarray:
    """1 for each text that has one of the words as a whole run of word characters."""
    hit = np.zeros(len(ends), dtype=np.int32)
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:]
    end[:-1] &= ~word[1:] | last[:-1]
    at = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - at
    some = size <= 8
    at, size = at[some], size[some]
    key = np.zeros(len(at), dtype=np.uint64)
    wide = np.zeros(len(at), dtype=bool)
    for j in range(8):
        mine = np.flatnonzero(size > j)
        c = low[at[mine] + j]
        wide[mine] |= c > 255
        key[mine] |= c.astype(np.uint64) << np.uint64(8 * j)
    found = at[np.isin(key, keys) & ~wide]
    hit[np.searchsorted(ends, found, side="right")] = 1
    return hit


def stats_frame(texts: pd.Series, literals: Literals | None = None, words: np.ndarray | None = None) -> pd.DataFrame:
    """The statistics of a batch of texts (NULL counts as '')."""
    t = tables()
    vals = texts.fillna("").tolist()
    lens = np.fromiter(map(len, vals), dtype=np.int64, count=len(vals))
    ends = np.cumsum(lens)
    starts = ends - lens
    cp = np.frombuffer("".join(vals).encode("utf-32-le"), dtype=np.uint32)

    def seg(flag: np.ndarray) -> np.ndarray:
        return np.fromiter((np.count_nonzero(flag[a:b]) for a, b in bounds), dtype=np.int32, count=len(vals))

    bounds = list(zip(starts.tolist(), ends.tolist()))
    bits = t["bits"][cp]
    alpha, upper, lower, space, emoji, exotic, word = ((bits & (1 << i)) != 0 for i in range(len(BITS)))
    first = np.zeros(len(cp), dtype=bool)          # first char of its post
    first[starts[lens > 0]] = True
    last = np.zeros(len(cp), dtype=bool)           # last char of its post
    last[ends[lens > 0] - 1] = True
    prev_space = np.empty(len(cp), dtype=bool)
    prev_space[1:] = space[:-1]
    if len(cp):
        prev_space[0] = True
    prev_space |= first
    token_start = ~space & prev_space
    # interior capital: non-space neighbours on both sides in the same post,
    # and a lower-case letter on at least one side (str.split() tokens)
    has_prev = ~first & ~prev_space
    next_space = np.empty(len(cp), dtype=bool)
    next_space[:-1] = space[1:]
    if len(cp):
        next_space[-1] = True
    has_next = ~last & ~next_space
    prev_lower = np.zeros(len(cp), dtype=bool)
    prev_lower[1:] = lower[:-1]
    next_lower = np.zeros(len(cp), dtype=bool)
    next_lower[:-1] = lower[1:]
    mid = upper & ~space & has_prev & has_next & (prev_lower | next_lower)
    at = np.flatnonzero(mid)
    marked = np.searchsorted(np.flatnonzero(token_start), at, side="right") if len(at) else at
    new_token = np.ones(len(marked), dtype=bool)
    new_token[1:] = marked[1:] != marked[:-1]
    pos = at[new_token]
    per_post = np.bincount(np.searchsorted(ends, pos, side="right"),
                           minlength=len(vals)).astype(np.int32)
    low = t["fold"][cp] if literals is not None or words is not None else cp
    out = pd.DataFrame({
        "char_len": lens.astype(np.int32),
        "alpha": seg(alpha),
        "upper": seg(upper),
        "words": seg(token_start),
        "emoji": seg(emoji),
        "excl": seg(cp == 33),
        "quest": seg(cp == 63),
        "newline": seg(cp == 10),
        "mid_caps_tokens": per_post,
        "exotic": seg(exotic),
        "word_hit": word_hits(low, word, first, last, ends, words) if words is not None else np.zeros(len(vals), dtype=np.int32),
    })
    if literals is not None:
        for i, mask in enumerate(literals.masks(low, ends)):
            out[f"found{i}"] = mask
    return out


@lru_cache(maxsize=None)
def _stats(literals: tuple[str, ...], words: tuple[str, ...]):
    longs = -(-len(literals) // PER_LONG)
    schema = T.StructType([*(T.StructField(f, T.IntegerType()) for f in FIELDS),
                           *(T.StructField(f"found{i}", T.LongType()) for i in range(longs))])

    @F.pandas_udf(schema)
    def char_stats_of(texts: pd.Series) -> pd.DataFrame:
        return stats_frame(texts, Literals(literals) if literals else None,
                           np.array([_word_key(w) for w in words], dtype=np.uint64) if words else None)
    return char_stats_of


def char_stats(text: Column, literals: tuple[str, ...] = (), words: tuple[str, ...] = ()) -> Column:
    """Struct column of the per-character statistics of ``text``.

    With which of the (lower-case) ``literals`` and whether any of the ``words`` are in it, see ``Found``.
    """
    from acctsig.session import ship_package
    ship_package()
    return _stats(literals, words)(text)


class Found:
    """A lower-cased text of which is known what literals and words it has.

    It stands for the lower-case column of ``text.gated_any`` and ``text.word_set_any``:
    ``contains`` is a bit of the statistics where the literal was sought there.
    """

    def __init__(self, text: Column, cs: Column, literals: tuple[str, ...] = (), words: tuple[str, ...] = ()):
        self.column, self._cs, self._at, self.words = F.lower(text), cs, {k: i for i, k in enumerate(literals)}, words

    def contains(self, k: str) -> Column:
        i = self._at.get(k)
        if i is None:
            return self.column.contains(k)
        return self._cs[f"found{i // PER_LONG}"].bitwiseAND(F.lit(1 << (i % PER_LONG))) != 0

    def word_hit(self) -> Column:
        return self._cs["word_hit"] == 1

    def exotic(self) -> Column:
        return self._cs["exotic"] > 0


def sought(keys: list[str]) -> tuple[str, ...]:
    """Those literals, once each, that ``Literals`` can tell."""
    return tuple(sorted({k for k in keys if k and not _UNSURE & set(k)}))


def sought_words(words: list[str]) -> tuple[str, ...]:
    """Those words, once each, that ``word_hits`` can tell."""
    return tuple(sorted({w for w in words if 0 < len(w) <= 8 and max(map(ord, w)) < 256}))
