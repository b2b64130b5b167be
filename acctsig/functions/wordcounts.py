"""Word counts per account, in one pass over the text.

A batch's texts are split by Python's own rules and counted per account. What is
exchanged are packed counts, a row per account and batch: the words joined by
blanks and compressed, their counts as small integers. A task then adds up the counts of
some accounts at a time, so what grows with the posts is neither a
row per word nor a table of all accounts' words. An account with many posts is
one row per batch, of at most as many words as it has distinct ones there.

Neither side handles words one by one: what separates words is looked up by code
point (the tables of ``charstats``), Arrow splits and numbers the words of a piece, and
entries (account, word) are numbers that numpy sorts and adds up.
"""

from __future__ import annotations

import re
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from acctsig.functions import charstats

TOKEN, TERM = 0, 1  # str.split() of the lower-cased text; its runs of two or more word characters
_TERMS = re.compile(r"\w{2,}")  # what TERM means; the tests compare
# Words that a task sends on at once.
HELD = 200_000
PIECE = 1 << 20  # characters that are split at once
MERGED = 16 << 20  # bytes of words that are added up at once


class Counts(NamedTuple):
    """The counts of some accounts: entry i is word ``words[code[i]]`` of account ``of[i]``, ``n[i]`` times; ``of`` ascends."""
    keys: list[tuple]
    words: pa.Array
    of: np.ndarray
    code: np.ndarray
    n: np.ndarray

    def starts(self) -> np.ndarray:
        """Where the entries of each account start, and the end of the last one's."""
        return np.searchsorted(self.of, np.arange(len(self.keys) + 1))

    def where(self, mask: np.ndarray) -> Counts:
        return self._replace(of=self.of[mask], code=self.code[mask], n=self.n[mask])

    def looked_up(self, found) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (first key, word) of the entries, each looked up once: ``found(first key, word)`` of each pair, and each entry's pair."""
        first = {k: i for i, k in enumerate(dict.fromkeys(k[0] for k in self.keys))}
        names, size = list(first), max(len(self.words), 1)
        number = np.array([first[k[0]] for k in self.keys], dtype=np.int64)
        pairs, entry = np.unique(number[self.of] * size + self.code, return_inverse=True)
        words = self.words.to_pylist()
        return [found(names[p // size], words[p % size]) for p in pairs.tolist()], entry


def _added(keys: list[tuple], of: np.ndarray, words: pa.Array, n: np.ndarray | None) -> Counts:
    """The counts from words of accounts, each with its count or once."""
    numbered = words.dictionary_encode()
    size = max(len(numbered.dictionary), 1)
    entry = of.astype(np.int64) * size + numbered.indices.to_numpy(zero_copy_only=False)
    if n is None:
        entry, total = np.unique(entry, return_counts=True)
    else:
        order = np.argsort(entry, kind="stable")
        entry = entry[order]
        at = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, dtype=np.int64)
        entry, total = entry[at], np.add.reduceat(n[order], at) if len(at) else n
    return Counts(keys, numbered.dictionary, entry // size, entry % size, total.astype(np.int64))


def _split(low: list[str]):
    """A function of a kind: the words of lower-cased texts as a list per text; among them may be empty ones."""
    table = charstats.tables()
    cp = np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, low)]).tolist()

    def of(kind):
        apart = table["space"][cp] if kind == TOKEN else ~table["word"][cp]
        text = np.where(apart, np.uint32(32), cp).tobytes().decode("utf-32-le")
        return pc.split_pattern(pa.array([text[a:b] for a, b in zip(ends, ends[1:])], pa.string()), " ")

    return of


def numbered(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of lower-cased texts in order: a number for each word, and the text it is in."""
    lists = _split(low)(TOKEN)
    code = lists.values.dictionary_encode()
    of = np.repeat(np.arange(len(low)), np.diff(lists.offsets.to_numpy()))
    code, some = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.utf8_length(code.dictionary).to_numpy(zero_copy_only=False) > 0
    return code[some[code]], of[some[code]]


def _counted(keys: list[tuple], low: list[str], kinds):
    """(kind, counts) of accounts' lower-cased texts."""
    split = _split(low)
    for kind in kinds:
        lists = split(kind)
        c = _added(keys, np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy())), lists.values, None)
        least = 1 if kind == TOKEN else 2
        yield kind, c.where((pc.utf8_length(c.words).to_numpy(zero_copy_only=False) >= least)[c.code])


def _packed(n: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 4 or 8 bytes each."""
    most = int(n.max())
    return n.astype(np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.int64).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype={1: np.uint8, 4: np.uint32, 8: np.int64}[len(data) // size])


def _joined(c: Counts, starts: np.ndarray) -> list[pa.Buffer]:
    """The words of each account joined by blanks."""
    words = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), c.words.take(pa.array(c.code)))
    return [x.as_buffer() for x in pc.binary_join(words, " ").cast(pa.binary())]


def _of_batches(n_keys: int, kinds, kept):
    """A function of batches (keys.., text): (key, kind, words, counts) of each account and batch.

    ``kept(counts)`` may leave out words.
    """
    def pieces(texts: dict[tuple, list[str]]):
        keys, low, size = [], [], 0
        for key, mine in texts.items():
            keys.append(key)
            low.append("\n".join(mine).lower())  # a line feed is no part of a word
            size += len(low[-1])
            if size >= PIECE:
                yield keys, low
                keys, low, size = [], [], 0
        if keys:
            yield keys, low

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for b in batches:
            texts: dict[tuple, list[str]] = {}
            for key, t in zip(zip(*(b.column(i).to_pylist() for i in range(n_keys))), b.column(n_keys).to_pylist()):
                if t:
                    texts.setdefault(key, []).append(t)
            keys, kind_of, words, sizes, counts = [], [], [], [], []
            for some, low in pieces(texts):
                for kind, c in _counted(some, low, kinds):
                    c = kept(c)
                    at = c.starts()
                    for key, joined, a, z in zip(some, _joined(c, at), at[:-1].tolist(), at[1:].tolist()):
                        if a < z:
                            keys.append(key)
                            kind_of.append(kind)
                            words.append(codec.compress(joined, asbytes=True))
                            sizes.append(joined.size)
                            counts.append(_packed(c.n[a:z]))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([k[i] for k in keys], b.column(i).type) for i in range(n_keys)), pa.array(kind_of, pa.int32()),
                     pa.array(words, pa.binary()), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary())],
                    names=[*b.schema.names[:n_keys], "kind", "words", "size", "counts"])
    return run


def _merged(keys: list[tuple], rows: list[tuple[int, bytes, np.ndarray]]) -> Counts:
    """The counts from rows (account, words joined by blanks, counts)."""
    data = b" ".join(words for _, words, _ in rows)
    text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], dtype=np.int32)), pa.py_buffer(data))
    of = np.repeat(np.array([i for i, _, _ in rows], dtype=np.int64), [len(n) for _, _, n in rows])
    return _added(keys, of, pc.split_pattern(text, " ").values, np.concatenate([n.astype(np.int64) for _, _, n in rows]))


def _by_account(batches, n_keys: int):
    """``Counts`` of some whole accounts (key.., kind) at a time, from rows that lie together by them.

    What is held are ``MERGED`` bytes of words, or twice the distinct words of an account that has more.
    """
    def given():
        for b in batches:
            yield from zip(zip(*(b.column(i).to_pylist() for i in range(n_keys + 1))),
                           *(b.column(n_keys + i).to_pylist() for i in (1, 2, 3)))

    codec = pa.Codec("zstd", 1)
    keys, rows, size, most = [], [], 0, MERGED
    for key, group in groupby(given(), key=lambda r: r[0]):
        if size >= most:
            yield _merged(keys, rows)
            keys, rows, size = [], [], 0
        most = MERGED
        keys.append(key)
        for _, words, joined, counts in group:
            words = codec.decompress(words, joined, asbytes=True)
            rows.append((len(keys) - 1, words, _unpacked(counts, words.count(b" ") + 1)))
            size += joined
            if size >= 2 * most:  # one account has much of it: whole ones go, what there is of it is added up
                c = _merged(keys, rows)
                at = int(np.searchsorted(c.of, len(keys) - 1))
                if at:
                    yield c._replace(keys=keys[:-1], of=c.of[:at], code=c.code[:at], n=c.n[:at])
                mine = Counts([key], c.words, np.zeros(len(c.of) - at, dtype=np.int64), c.code[at:], c.n[at:])
                held = _joined(mine, mine.starts())[0].to_pybytes()
                keys, rows, size = [key], [(0, held, mine.n)], len(held)
                most = max(MERGED, size)
    if keys:
        yield _merged(keys, rows)


def packed_counts(posts: DataFrame, text: str, keys, kinds=(TOKEN, TERM), kept=lambda counts: counts) -> DataFrame:
    """The packed counts of all batches, those of an account and kind next to each other."""
    from acctsig.session import ship_package
    ship_package(posts.sparkSession)
    schema = T.StructType([*(T.StructField(k, posts.schema[k].dataType) for k in keys), T.StructField("kind", T.IntegerType()),
                           T.StructField("words", T.BinaryType()), T.StructField("size", T.IntegerType()),
                           T.StructField("counts", T.BinaryType())])
    return (posts.select(*keys, F.col(text)).mapInArrow(_of_batches(len(keys), kinds, kept), schema)
            .repartition(*keys, "kind").sortWithinPartitions(*keys, "kind"))


def word_counts(posts: DataFrame, text: str, keys, kinds=(TOKEN, TERM)) -> DataFrame:
    """``(keys.., kind, word, n)`` over each account's posts; null texts have no words."""
    return counts_of(packed_counts(posts, text, keys, kinds), keys)


def counts_of(packed: DataFrame, keys) -> DataFrame:
    """``(keys.., kind, word, n)`` from ``packed_counts``."""
    n_keys = len(keys)
    types = [to_arrow_type(f.dataType) for f in packed.schema.fields[:n_keys + 1]]
    schema = T.StructType([*packed.schema.fields[:n_keys + 1], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for c in _by_account(batches, n_keys):
            for at in range(0, len(c.of), HELD):
                of = pa.array(c.of[at:at + HELD])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([k[i] for k in c.keys], t).take(of) for i, t in enumerate(types)),
                     c.words.take(pa.array(c.code[at:at + HELD])), pa.array(c.n[at:at + HELD])], names=schema.names)

    return packed.mapInArrow(run, schema)


def term_vectors(posts: DataFrame, text: str, keys, index: dict, packed: DataFrame | None = None) -> DataFrame:
    """``(keys.., idx[], u[])``: each account's weights (count times the term's weight) of length 1, one row per account that has one.

    ``index`` has a dictionary from term to (number, weight) for each value of the first key.
    ``packed``: the posts' packed counts of terms, if there already.
    """
    sc = posts.sparkSession.sparkContext
    shared = sc.broadcast(index)
    none: dict = {}

    def of(first, word):
        return shared.value.get(first, none).get(word)

    def kept(c):
        found, entry = c.looked_up(lambda first, word: word in shared.value.get(first, none))
        return c.where(np.array(found, dtype=bool)[entry])

    whole = packed is not None
    packed = packed if whole else packed_counts(posts, text, keys, (TERM,), kept)
    n_keys = len(keys)
    schema = T.StructType([*packed.schema.fields[:n_keys], T.StructField("idx", T.ArrayType(T.IntegerType())),
                           T.StructField("u", T.ArrayType(T.DoubleType()))])

    types = [to_arrow_type(f.dataType) for f in packed.schema.fields[:n_keys]]

    def run(batches):
        for c in _by_account(batches, n_keys):
            found, entry = c.looked_up(of)
            number = np.array([-1 if x is None else x[0] for x in found], dtype=np.int32)[entry]
            c, number, weight = c.where(number >= 0), number[number >= 0], np.array([0.0 if x is None else x[1] for x in found])[entry][number >= 0]
            w = weight * c.n
            at = c.starts()
            some = np.flatnonzero(np.diff(at))
            if not len(some):
                continue
            w /= np.sqrt(np.add.reduceat(w * w, at[some]))[np.searchsorted(some, c.of)]
            for first in range(0, len(some), 200):
                mine = some[first:first + 200]
                offsets = pa.array(at[[*mine, mine[-1] + 1]] - at[mine[0]], pa.int32())
                a, z = at[mine[0]], at[mine[-1] + 1]
                keys = [c.keys[i] for i in mine.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([k[i] for k in keys], t) for i, t in enumerate(types)), pa.ListArray.from_arrays(offsets, pa.array(number[a:z])),
                     pa.ListArray.from_arrays(offsets, pa.array(w[a:z]))], names=schema.names)

    return packed.mapInArrow(run, schema)


def account_sums(packed: DataFrame, keys, sums, names: list[str]) -> DataFrame:
    """``(keys.., names..)``: whole numbers that ``sums(counts)`` gives, an array per name, for the accounts of ``Counts``.

    ``packed``: counts of one kind, from ``packed_counts``.
    """
    n_keys = len(keys)
    types = [to_arrow_type(f.dataType) for f in packed.schema.fields[:n_keys]]
    schema = T.StructType([*packed.schema.fields[:n_keys], *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches):
        for c in _by_account(batches, n_keys):
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in c.keys], t) for i, t in enumerate(types)),
                                              *(pa.array(x.astype(np.int64)) for x in sums(c))], names=schema.names)

    return packed.mapInArrow(run, schema)


def corpus_sums(packed: DataFrame, keys) -> DataFrame:
    """``(first key, word, df, ctf)``: accounts that have a word, and its count; partial rows, to be added up.

    A task adds up the words of as many accounts as ``_by_account`` gives at once before it sends them on.
    """
    n_keys = len(keys)
    first = to_arrow_type(packed.schema.fields[0].dataType)
    schema = T.StructType([packed.schema.fields[0], T.StructField("word", T.StringType()), T.StructField("df", T.LongType()),
                           T.StructField("ctf", T.LongType())])

    def run(batches):
        for c in _by_account(batches, n_keys):
            pairs, entry = c.looked_up(lambda first, word: (first, word))
            df, ctf = np.bincount(entry), np.zeros(len(pairs), dtype=np.int64)
            np.add.at(ctf, entry, c.n)
            for at in range(0, len(pairs), HELD):
                mine = pairs[at:at + HELD]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in mine], first), pa.array([w for _, w in mine], pa.string()),
                                                  pa.array(df[at:at + HELD]), pa.array(ctf[at:at + HELD])], names=schema.names)

    return packed.mapInArrow(run, schema)


def of_kind(counts: DataFrame, kind: int, word: str, n: str) -> DataFrame:
    """The counts of one kind, under the names of its readers."""
    return counts.where(F.col("kind") == kind).drop("kind").withColumnsRenamed({"word": word, "n": n})
