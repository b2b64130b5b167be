"""Weighted backoff automaton of an n-gram model, walked once over every text.

The tokens of a text are its words and one end; before its first word stands an
end as context. Every n-gram of the training texts up to ``ORDER`` is kept, so the
model grows with the corpus. A context that was followed by something is a
state. It has an arc for each word that followed it, of the interpolated
probability (c - D) / total + g p, p being that of the word after the next shorter
context, and a failure arc of weight g = D arcs / total to that context. The root
has an arc for every word, of probability (c + 1) / (N + V + 1).

No machine holds the automaton. The texts lie in batches, each with the part of it
that they can reach: the n-grams that occur in them. A batch's distinct words go with
their training counts to shards by hash, which add them up and number them by falling
count. Then its distinct longest n-grams go to shards by how they begin, so a shard has
a context with all that follows it and can tell its count and arcs as well; the shards
answer in the order asked. Then each batch builds its arcs and failure arcs and walks
its texts from left to right, carrying the state. Requests are sorted, packed arrays of
differences, answers tell by how much counts exceed the batch's own, so what is shuffled
is a few bytes per n-gram. Each step is stored, and what only led to it is removed.

A context of words that each make up more than one token in ``HOT`` (at most
``HOT`` ** (ORDER - 1) contexts) may hold any share of the n-grams; its n-grams are
dealt by their next word too, and its counts, added up over the shards, are sent to
all batches. Words are known by 64-bit hashes before they have numbers; among V of
them two collide with a chance of about V * V / 2 ** 65.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm.common import field, prepare, scratch, slices, words

END = b"\n"  # no word holds a line feed
ORDER = 3
DISCOUNT = 0.75
HOT = 1_000
BATCH_TOKENS = 250_000  # of a batch, or one text; its automaton takes some 100 MB
SHARD_GRAMS = 500_000
MOST_TASKS = 20_000  # beyond it a task takes several batches or shards, one after the other


# -- packed arrays -------------------------------------------------------------

_ZIP, _UNZIP = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, byte by byte, compressed; small numbers take 32 bits before that."""
    wide = any(len(c) and (c.max() > 2**31 - 1 or c.min() < -(2**31)) for c in columns)
    flat = np.concatenate([np.asarray(c, "<i8" if wide else "<i4") for c in columns])
    planes = flat.view(np.uint8).reshape(len(columns), -1, 8 if wide else 4).transpose(0, 2, 1)
    return bytes([wide]) + _ZIP.compress(planes.tobytes())


def _unpack(body: bytes, n: int) -> list[np.ndarray]:
    width = 8 if body[0] else 4
    planes = np.frombuffer(_UNZIP.decompress(body[1:]), np.uint8).reshape(n, width, -1).transpose(0, 2, 1)
    flat = np.ascontiguousarray(planes).view("<i8" if body[0] else "<i4")
    return list(flat.reshape(n, -1).astype(np.int64))


def _pack_rising(hashes: np.ndarray) -> bytes:
    """Rising unsigned 64-bit numbers."""
    return _pack(np.diff(hashes, prepend=np.uint64(0)).view(np.int64))


def _unpack_rising(body: bytes) -> np.ndarray:
    return np.cumsum(_unpack(body, 1)[0].view(np.uint64), dtype=np.uint64)


def _runs(columns: list[np.ndarray], size: int) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    fresh = np.arange(size) == 0
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _in_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of numbers from 0; columns that fit into one 64-bit number together are sorted together."""
    keys = [columns[0]]
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if (int(keys[-1].max(initial=0)) + 1) * size < 2**63:
            keys[-1] = keys[-1] * size + c
        else:
            keys.append(c)
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of rows of integers."""
    h = np.full(len(columns[0]) if columns else 0, 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h


# -- batches -------------------------------------------------------------------

def _numbering() -> defaultdict:
    """Numbers new words from 0 as they come."""
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


def _batches(rows: DataFrame, id_type) -> DataFrame:
    """Texts as sequences of word numbers of their batch, in order of the words' hashes: ids, train flags, lengths, numbers, hashes."""
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.BinaryType()),
                           T.StructField("numbers", T.BinaryType()), T.StructField("hashes", T.BinaryType()),
                           T.StructField("tokens", T.LongType())])

    def run(batches):
        task, nth, held = TaskContext.get().partitionId(), 0, 0
        ids, train, lengths, numbers, local = [], [], [], [], _numbering()

        def flushed():
            h = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in local), np.uint64, len(local))
            order = np.argsort(h)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            row = [pa.array([(task << 32) + nth]), pa.array([ids], pa.list_(_arrow(id_type))), pa.array([train], pa.list_(pa.bool_())),
                   pa.array([_pack(np.array(lengths))]), pa.array([_pack(rank[np.concatenate(numbers)])]),
                   pa.array([_pack_rising(h[order])]), pa.array([sum(lengths)])]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                for i, text, is_train in zip(*(part.column(c).to_pylist() for c in ("id", "text", "train"))):
                    seq = [END, *words(text), END]
                    ids.append(i)
                    train.append(bool(is_train))
                    lengths.append(len(seq))
                    numbers.append(np.fromiter(map(local.__getitem__, seq), np.int64, len(seq)))
                    held += len(seq)
                    if held >= BATCH_TOKENS:
                        yield flushed()
                        nth, held = nth + 1, 0
                        ids, train, lengths, numbers, local = [], [], [], [], _numbering()
        if ids:
            yield flushed()

    return rows.mapInArrow(run, schema)


class Batch:
    """A batch's n-grams: per order the distinct ones by context, last word and suffix, and their training counts.

    Within an order they are numbered by (context, last word), so every pass numbers them alike.
    """

    def __init__(self, row: dict, order: int):
        self.row = row
        self.lengths, self.numbers = _unpack(row["lengths"], 1)[0], _unpack(row["numbers"], 1)[0]
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        place = np.arange(len(text)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        seen = np.array(row["train"], bool)[text]
        size, real = int(self.numbers.max(initial=-1)) + 1, place >= 1  # every word occurs
        self.counts = [np.bincount(self.numbers[real], seen[real], size).astype(np.int64)]
        self.context, self.word, self.suffix = [None], [np.arange(size)], [None]
        self.end = int(self.numbers[0])  # which stands before each text
        at = self.numbers
        self.at = [at]  # the number of the n-gram that ends at each place (-1: the text begins later)
        for k in range(2, order + 1):
            use = np.flatnonzero(place >= k - 1)
            key = at[use - 1] * size + self.numbers[use]
            by = np.argsort(key)
            key = key[by]
            fresh = _runs([key], len(key))
            of = np.empty(len(by), np.int64)
            of[by] = np.cumsum(fresh) - 1
            self.context.append(key[fresh] // size)
            self.word.append(key[fresh] % size)
            self.suffix.append(at[use[by[fresh]]])
            self.counts.append(np.bincount(of, seen[use], int(fresh.sum())).astype(np.int64))
            at = np.full(len(text), -1)
            at[use] = of
            self.at.append(at)


def _cuts(hashes: np.ndarray, shards: int) -> list[int]:
    """Where the words of each shard begin: shards are ranges of hashes."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64)).tolist()


def _rising(columns: list[np.ndarray], starts: np.ndarray | bool = False) -> list[np.ndarray]:
    """Columns of sorted rows as differences from the row before, each as long as those before it stay; anew at ``starts``."""
    out = []
    for i, c in enumerate(columns):
        d = np.diff(c, prepend=0)
        fresh = _runs(columns[:i], len(c)) | starts
        d[fresh] = c[fresh]
        out.append(d)
    return out


def _risen(columns: list[np.ndarray], starts: np.ndarray | bool = False) -> list[np.ndarray]:
    """The columns that ``_rising`` was given."""
    out: list[np.ndarray] = []
    for d in columns:
        total, at = np.cumsum(d), np.flatnonzero(_runs(out, len(d)) | starts)
        out.append(total - np.repeat(total[at] - d[at], np.diff(np.append(at, len(d)))))
    return out


def _starts(ends: np.ndarray) -> np.ndarray:
    """Marks the first row of each of the parts that end before these rows."""
    out = np.zeros(int(ends[-1]), bool)
    out[0] = True
    out[ends[:-1]] = True
    return out


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _renumbered(found: list[dict]) -> dict:
    """A batch with its words in order of their global numbers, and those and their counts beside it."""
    # The answers of the word shards, in their order, are those of the words in order of their hashes.
    parts = [_unpack(r["body"], 2) for r in found[1:]]
    for p in parts:
        gid, p[1] = p[0], np.empty_like(falls := p[1])
        p[1][np.argsort(gid)] = np.cumsum(falls)
    gid, total = (np.concatenate(c) for c in zip(*parts))
    by = np.argsort(gid)
    row = {c: found[0][c] for c in ("batch", "ids", "train", "lengths")}
    return row | {"numbers": _pack(_inverse(by)[_unpack(found[0]["numbers"], 1)[0]]),
                  "words": _pack(np.diff(gid[by], prepend=0), total[by])}


class Dealt:
    """How a batch's n-grams are dealt to shards.

    Only the longest are sent: rows of ``order`` words by number from 1, those that begin at a text's last
    words filled up with 0. What begins alike, up to the first word that is not hot, goes to one shard, so
    a context is whole there unless all its words are hot. ``hot`` is the number of hot words that a row
    begins with, ``order - 1`` at most. Rows lie by shard, ``hot`` and words; ``node`` has the number of
    the n-gram that each row's first 1, 2, ... words are (-1: filled up).
    """

    def __init__(self, batch: Batch, tokens: int, shards: int, hot_share: int):
        self.batch, order = batch, len(batch.word)
        gid, self.total = _unpack(batch.row["words"], 2)
        gid, frequent = np.append(0, np.cumsum(gid) + 1), np.append(False, self.total * hot_share > tokens)
        nodes = []
        for k in range(2, order + 1):
            at = np.arange(len(batch.word[k - 1])) if k == order else np.flatnonzero(batch.word[k - 1] == batch.end)
            chain = [np.full(len(at), -1)] * (order - k) + [at]
            for d in range(k - 1, 0, -1):
                chain.append(batch.context[d][chain[-1]])
            nodes.append(chain[::-1])
        self.node = [np.concatenate(c) for c in zip(*nodes)]
        local = [np.append(w + 1, 0)[n] for n, w in zip(self.node, batch.word)]
        by = _in_order(local)
        local = [c[by] for c in local]
        self.columns = [gid[c] for c in local]
        self.hot, lead = np.zeros(len(by), np.int64), np.ones(len(by), bool)
        for c in local[:-1]:
            lead = lead & frequent[c]
            self.hot += lead
        h = _mixed(self.columns[:1])
        for d in range(1, order):
            on = np.flatnonzero(self.hot >= d)
            h[on] = _mixed([h[on].view(np.int64), self.columns[d][on]])
        shard = (h % np.uint64(shards)).astype(np.int64)
        last = np.argsort((shard * order + self.hot).astype(np.min_scalar_type(shards * order)), kind="stable")
        self.node, self.columns = [n[by[last]] for n in self.node], [c[last] for c in self.columns]
        self.hot, shard = self.hot[last], shard[last]
        self.starts = _runs([shard], len(shard))
        self.cuts = np.append(np.flatnonzero(self.starts), len(shard)).tolist()
        self.shards = shard[self.cuts[:-1]].tolist()

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """Each shard's rows."""
        n = np.append(self.batch.counts[-1], 0)[self.node[-1]]
        for k in range(2, len(self.node)):  # the filled-up rows are the n-grams that end a text
            filled = (self.node[k] < 0) & (self.node[k - 1] >= 0)
            n[filled] = self.batch.counts[k - 1][self.node[k - 1][filled]]
        columns = [*_rising([self.hot, *self.columns], self.starts), n]
        for s, i, j in zip(self.shards, self.cuts, self.cuts[1:]):
            yield s, _pack(*(c[i:j] for c in columns))

    def counted(self, answers: list[dict], hot: dict[int, tuple]) -> tuple[list, list]:
        """Of the n-grams of each order: how often they occur, and by how many words they are followed (not of the longest)."""
        order, b = len(self.node), self.batch
        values, arcs = [self.total, *(c.copy() for c in b.counts[1:])], [np.zeros(len(w), np.int64) for w in b.word[:-1]]
        begins = [_runs(self.columns[:d + 1], len(self.starts)) | self.starts for d in range(order - 1)]  # a context's first row in its shard
        whole = [f & (self.hot <= d) for d, f in enumerate(begins)]
        sizes = [np.diff(np.cumsum(f)[np.array(self.cuts[1:]) - 1], prepend=0).tolist() for f in whole]
        more: list[list] = [[] for _ in range(2 * order)]
        for nth, r in enumerate(answers):
            flat, at = _unpack(r["body"], 1)[0], 0
            for part, size in [(0, self.cuts[nth + 1] - self.cuts[nth]),
                               *((2 * d + i, sizes[d][nth]) for d in range(order - 1) for i in ((1, 2) if d else (2,)))]:
                more[part].append(flat[at:at + size])
                at += size
        real = self.node[-1] >= 0
        values[-1][self.node[-1][real]] += np.concatenate(more[0])[real]
        for d, f in enumerate(whole):
            real = self.node[d][f] >= 0
            at = self.node[d][f][real]
            if d:
                values[d][at] += np.concatenate(more[2 * d + 1])[real]
            arcs[d][at] = values[d][at] - np.concatenate(more[2 * d + 2])[real]
            split = begins[d] & (self.hot > d)
            if split.any():
                at = self.node[d][split]
                keys, n, a = hot[d + 1]
                place = np.searchsorted(keys, _mixed([c[split] for c in self.columns[:d + 1]]).view(np.int64))
                values[d][at], arcs[d][at] = n[place], a[place]
        return values, arcs


# -- shards ----------------------------------------------------------------------

ANSWER = ("batch long, k int, shard int, body binary, context long, above long, total long, arcs long")


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["batch", "k", "shard", "body", "context", "above", "total", "arcs"])


def _grouped(batches, keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, of rows that arrive in their order."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(r)
    if held:
        yield now, held


def _numbered_words(shards: int):
    """Per shard of words: numbers, by falling count, and counts, in their order as differences, for each batch, and N and V."""
    def run(batches):
        for (_, shard), asked in _grouped(batches, ["k", "shard"]):
            hashes = [_unpack_rising(r["hashes"]) for r in asked]
            every, of = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(of, np.concatenate([_unpack(r["body"], 1)[0] for r in asked]), len(every)).astype(np.int64)
            out = [(-1, 1, shard, None, None, None, int(n.sum()), int((n > 0).sum()))]
            number = _inverse(np.argsort(-n, kind="stable")) * shards + shard
            ends = np.cumsum([len(h) for h in hashes])
            for r, h, end in zip(asked, hashes, ends):
                at = of[end - len(h):end]
                gid = number[at]
                out.append((r["batch"], 1, shard, _pack(gid, np.diff(n[at][np.argsort(gid)], prepend=0)), None, None, None, None))
            yield _answer(out)
    return run


def _counted(order: int):
    """Per shard: for each batch how much oftener than in it its n-grams and its whole contexts occur, and how much
    oftener than by different words those are followed; parts of the numbers of hot contexts.
    """
    def run(batches):
        for (shard,), asked in _grouped(batches, ["shard"]):
            parts = [_unpack(r["body"], order + 2) for r in asked]
            ends = np.cumsum([len(p[0]) for p in parts])
            starts = _starts(ends)
            columns = [np.concatenate(c) for c in zip(*parts)]
            del parts
            n = columns.pop()
            lead, *columns = _risen(columns, starts)
            by = _in_order(columns)
            back, in_order, lead_of = _inverse(by), [c[by] for c in columns], lead[by]
            firsts = [_runs(in_order[:d + 1], len(by)) for d in range(order)]
            of = [np.cumsum(f, dtype=np.int32) - 1 for f in firsts]
            values = [np.bincount(o, n[by]).astype(np.int64) for o in of]
            arcs, out = [], []
            for d in range(order - 1):
                next_ = firsts[d + 1]
                # A next context that is split as well is counted when its parts are put together.
                follows = (values[d + 1] > 0) & (in_order[d + 1][next_] > 0) & (lead_of[next_] <= d + 1)
                arcs.append(np.bincount(of[d][next_], follows, len(values[d])).astype(np.int64))
                split = lead_of[firsts[d]] > d
                heads = [c[firsts[d]][split] for c in in_order[:d + 1]]
                above = _mixed(heads[:-1]) if d else np.zeros(int(split.sum()), np.uint64)
                out += [(-2, d + 1, shard, None, *r) for r in zip(*(c.tolist() for c in (
                    _mixed(heads).view(np.int64), above.view(np.int64), values[d][split], arcs[d][split])))]
            sections = [(values[-1][of[-1][back]] - n, ends)]
            for d in range(order - 1):
                begins = _runs(columns[:d + 1], len(n)) | starts
                whole = lead[begins] <= d
                at = of[d][back[begins]][whole]
                until = np.cumsum(begins & (lead <= d))[ends - 1]
                if d:
                    sections.append((values[d][at] - np.bincount(np.cumsum(begins) - 1, n).astype(np.int64)[whole], until))
                sections.append((values[d][at] - arcs[d][at], until))
            cut = [np.split(c, until[:-1]) for c, until in sections]
            out += [(r["batch"], order, shard, _pack(np.concatenate(c)), None, None, None, None) for r, *c in zip(asked, *cut)]
            yield _answer(out)
    return run


def _hot_contexts(t: pa.Table, order: int) -> dict[int, tuple]:
    """Per length the hot contexts: hash (rising), how often they occur, and by how many words they are followed."""
    of, columns = t.column("k").to_numpy(), [t.column(c).to_numpy() for c in ("context", "total", "arcs", "above")]
    out = {k: tuple(c[of == k].copy() for c in columns) for k in range(1, order)}
    for k in range(2, order):
        np.add.at(out[k - 1][2], np.searchsorted(out[k - 1][0], out[k][3][out[k][1] > 0]), 1)
    return {k: v[:3] for k, v in out.items()}


# -- the walk --------------------------------------------------------------------

class Automaton:
    """The part of the automaton that a batch's texts can reach.

    A state is an n-gram that was followed by something, or the root, of no words. Before a word stands in the
    texts the n-gram that a state is, and the arc for that word is the n-gram of both, so arcs, failure arcs and
    where they lead lie by place and by the words of the state: ``log_p`` (above 0: no arc) and ``to``, ``weight``
    and ``fail``; the walk carries the number of words of the state it is in.
    """

    def __init__(self, b: Batch, counts: list, arcs: list, tokens: int, vocabulary: int, discount: float):
        order = len(b.word)
        # A context that nothing followed ends a text.
        totals = [c * (a > 0) for c, a in zip(counts, arcs)]
        p = [(counts[0] + 1) / (tokens + vocabulary + 1)]
        for k in range(1, order):
            t, a = totals[k - 1][b.context[k]], arcs[k - 1][b.context[k]]
            safe = np.maximum(t, 1)
            p.append(np.maximum(counts[k] - discount, 0) / safe + discount * a / safe * p[k - 1][b.suffix[k]])
        # A k-gram is a state if something followed it; failing goes to the longest suffix that is one.
        longest = [None]  # words of the longest suffix of a k-gram, itself included, that is a state
        self.weight, self.fail, self.log_p, self.to = [[]], [[]], [], []
        for k in range(1, order):
            shorter = longest[k - 1][b.suffix[k - 1]] if k > 1 else np.zeros(len(totals[0]), np.int64)
            is_state = totals[k - 1] > 0
            longest.append(np.where(is_state, k, shorter))
            weight = np.log10(discount * arcs[k - 1] / np.maximum(totals[k - 1], 1), out=np.zeros(len(shorter)), where=is_state)
            before = np.append(-1, b.at[k - 1][:-1])
            self.weight.append(array("d", np.append(weight, 0.0)[before].tobytes()))
            self.fail.append(np.append(shorter, 0).astype(np.uint8)[before].tobytes())
        for k in range(order):
            has_arc = counts[k] > 0 if k else np.ones(len(p[0]), bool)  # the root has one for every word
            log_p = np.log10(p[k], out=np.ones(len(p[k])), where=has_arc)
            # The longest state that the arc's words end in is where it leads.
            to = longest[k + 1] if k + 1 < order else longest[k][b.suffix[k]] if k else np.zeros(len(log_p), np.int64)
            self.log_p.append(array("d", np.append(log_p, 1.0)[b.at[k]].tobytes()))
            self.to.append(np.append(to, 0).astype(np.uint8)[b.at[k]].tobytes())
        self.start = int(longest[1][b.end]) if order > 1 else 0  # after an end, which each text starts with

    def score(self, begin: int, end: int) -> float:
        """Log10 probability of the tokens from one place to another, walked from the state after an end."""
        log_p, to, weight, fail = self.log_p, self.to, self.weight, self.fail
        state, total = self.start, 0.0
        for i in range(begin, end):
            p = log_p[state][i]
            while p > 0:
                total += weight[state][i]
                state = fail[state][i]
                p = log_p[state][i]
            total += p
            state = to[state][i]
        return total


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared checkpoint folder; the shuffle files that made it go when it is written."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def _dropped(spark, *paths: str) -> None:
    """Remove tables of ``_stored`` that a later one holds all of."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
           discount: float = DISCOUNT, hot_share: int = HOT) -> DataFrame:
    """Score every row of ``docs`` by the model of those where ``train`` holds.

    Returns id, ``train``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (the sum of log10((c + 1) / (N + V + 1))) and ``score``. A null text is empty: its
    one token is the end. Repeated rows count as often in training and keep a row each; other columns
    are not looked at. Without training texts every token is unknown and has probability one.
    """
    spark = prepare(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    id_type = field(rows, "id").dataType
    batches, batches_path = _stored(_batches(rows, id_type), "batches")
    all_tokens = batches.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-all_tokens // SHARD_GRAMS))
    word_shards = max(1, shards // 8)

    def ask_words(parts):
        for b in parts:
            for r in b.to_pylist():
                batch, hashes, out = Batch(r, 1), _unpack_rising(r["hashes"]), []
                cuts = _cuts(hashes, word_shards)
                for s, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if i < j:
                        out.append((r["batch"], 1, s, _pack(batch.counts[0][i:j]), _pack_rising(hashes[i:j])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["batch", "k", "shard", "body", "hashes"])

    numbers, numbers_path = _stored(
        batches.mapInArrow(ask_words, "batch long, k int, shard int, body binary, hashes binary")
        .repartition(min(word_shards, MOST_TASKS), "shard").sortWithinPartitions("k", "shard", "batch")
        .mapInArrow(_numbered_words(word_shards), ANSWER), "numbers")
    tokens, vocabulary = numbers.filter("batch = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "arcs"))).first()

    def with_answers(own: DataFrame, answers: DataFrame) -> DataFrame:
        """Every batch's own row and its answers, next to each other."""
        out = own.withColumns({"k": F.lit(0), "shard": F.lit(0), "body": F.lit(None).cast("binary")})
        out = out.unionByName(answers.filter("batch >= 0").select("batch", "k", "shard", "body"), allowMissingColumns=True)
        return out.repartition(max(1, min(MOST_TASKS, -(-all_tokens // (2 * BATCH_TOKENS)))), "batch").sortWithinPartitions("batch", "k", "shard")

    kept = T.StructType([batches.schema[c] for c in ("batch", "ids", "train", "lengths", "numbers")] + [T.StructField("words", T.BinaryType())])

    def renumber(parts):
        for _, found in _grouped(parts, ["batch"]):
            row = _renumbered(found)
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], _arrow(f.dataType)) for f in kept], names=kept.names)

    known, _ = _stored(with_answers(batches.drop("hashes", "tokens"), numbers).mapInArrow(renumber, kept), "known")
    _dropped(spark, batches_path, numbers_path)

    def ask_grams(parts):
        for b in parts:
            for r in b.to_pylist():
                dealt = Dealt(Batch(r, order), tokens, shards, hot_share)
                s, body = zip(*dealt.asked())
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(s), pa.int64()), pa.array(s, pa.int32()), pa.array(body, pa.binary())],
                                                 names=["batch", "shard", "body"])

    grams, hot = None, None
    if order > 1:
        grams, _ = _stored(known.mapInArrow(ask_grams, "batch long, shard int, body binary")
                           .repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "batch")
                           .mapInArrow(_counted(order), ANSWER), "grams")
        # At most HOT ** (order - 1) contexts.
        t = (grams.filter("batch = -2").groupBy("k", "context", "above").agg(F.sum("total").alias("total"), F.sum("arcs").alias("arcs"))
             .orderBy("k", "context").toArrow())
        hot = spark.sparkContext.broadcast(_hot_contexts(t, order))
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    mass = math.log10(tokens + vocabulary + 1)

    def walk(parts):
        for _, found in _grouped(parts, ["batch"]):
            row, b = found[0], Batch(found[0], order)
            if order > 1:
                counts, arcs = Dealt(b, tokens, shards, hot_share).counted(found[1:], hot.value)
            else:
                counts, arcs = [_unpack(row["words"], 2)[1]], []
            automaton = Automaton(b, counts, arcs, tokens, vocabulary, discount)
            base, found_word = np.log10(counts[0] + 1) - mass, counts[0] > 0
            out, at = [], 0
            for size in b.lengths.tolist():
                text = b.numbers[at + 1:at + size]
                out.append((size - 1, int(found_word[text].sum()), float(base[text].sum()), automaton.score(at + 1, at + size)))
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], _arrow(id_type)), pa.array(row["train"], pa.bool_()),
                                              *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64())))],
                                             names=schema.names)

    return ((with_answers(known, grams) if order > 1 else known).mapInArrow(walk, schema)
            .withColumn("train_tokens", F.lit(tokens).cast("long"))
            .select(id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)
