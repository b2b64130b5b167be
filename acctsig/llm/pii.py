"""Personal data: base spans by rule, further ones by candidates and boosted trees.

Base spans are those of four patterns with value checks (octets, Luhn, digit
counts). Beside them, high-recall generators propose overlapping spans that the
patterns miss: addresses with written-out or bracketed signs, defanged or spaced
IPs and IPv6, card numbers with other separators, phone numbers without a plus.
Gradient-boosted trees score each proposal by its format and its context, the
scores are calibrated per kind on held-out examples, and proposals of a
probability of ``PROBABILITY`` or more are taken, best first, where they
overlap no base span and none taken before.

The trees learn from the corpus's own base spans: as they stand and rewritten
into the forms that the patterns miss, against proposals that fail a value
check and against numbers, dates and phrases that are put in the same
places. The examples of all texts are found; at most ``EXAMPLES`` distinct ones,
those of smallest hash, are fitted, three quarters for the trees and one for
the calibration. A corpus without base spans has base results only (none).

Every text is read whole, and each pattern in time linear in its length. Nothing
but the examples is shuffled, once; repeated texts leave one example each.

Defined results. A null text is the empty text and has no spans. Rows are judged
one by one: repeated ids or rows each have a result, a null id too. Other columns
are kept aside. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm import boosted
from acctsig.llm.common import field, prepare, saved, signed, slices

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 20_000
PROBABILITY = 0.95
CALIBRATION = 40  # held-out examples, of either label, that a kind needs for a calibration of its own
REWRITES = 4  # positive and negative examples from one base span
AROUND = 48  # characters of context
Span = tuple[str, int, int]

# The base patterns; their starts are found in linear time below.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    # A match starts at the run of local characters before its sign, as far as the match before leaves it.
    end, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, sign + 1) if start < sign else None
        if m:
            yield "email", start, m.end()
        end = m.end() if m else sign + 1
        sign = text.find("@", end)


def _ips(text: str) -> Iterator[Span]:
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield "ip", at, at + size
            at += size + 1


def _cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def in_order(spans) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """The four kinds' spans, by start and kind; those of one kind don't overlap."""
    return in_order([*_emails(text), *_ips(text), *_cards(text), *_phones(text)])


# -- proposals ---------------------------------------------------------------

_OPEN, _CLOSE = r"[(\[{<]\x20?", r"\x20?[)\]}>]"
_AT = re.compile(r"[\x20(\[{<][aA][tT][\x20)\]}>]")
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:\x20?{_OPEN}(?:dot|\.){_CLOSE}\x20?|\x20dot\x20|\x20\.\x20|\.)[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_CLUSTER = re.compile(r"[0-9](?:[0-9]|[^\w\n]{1,3}(?=[0-9]))*")
_GROUP = re.compile(r"[0-9]+")
_CARD_FORMS = {(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 4)}


def _signs(text: str) -> Iterator[tuple[int, int]]:
    """Places of @ and the word at, with brackets and a space around."""
    places = [m.span() for m in _AT.finditer(text)]
    i = text.find("@")
    while i >= 0:
        bracket = text[i - 1:i] in ("(", "[", "{", "<") and text[i + 1:i + 2] in (")", "]", "}", ">")
        places.append((i - bracket, i + 1 + bracket))
        i = text.find("@", i + 1)
    for s, e in places:
        yield s - (s > 0 and text[s - 1] == " "), e + (text[e:e + 1] == " ")


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap, and many are none."""
    out: list[Span] = []
    for end, after in _signs(text):
        start = end
        while start > max(0, end - 64) and text[start - 1] in LOCAL:
            start -= 1
        if start < end and (host := _HOST.match(text, after)):
            out.append(("email", start, host.end()))
    if text.count(":") > 1:
        out += [("ip", m.start(), m.end()) for m in _IP6.finditer(text)]
    for c in _CLUSTER.finditer(text):
        if c.end() - c.start() < 6:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, c.start(), c.end())]
        sizes = [e - s for s, e in groups]
        for i, (s, _) in enumerate(groups):
            total, bracket = 0, text[s - 1:s] == "("
            first = s - bracket
            first -= text[max(0, first - 1):first] == "+"
            for j in range(i, min(i + 5, len(groups))):
                total += sizes[j]
                if total > 19:
                    break
                form = tuple(sizes[i:j + 1])
                if form in _CARD_FORMS or (i == j and 12 <= total):
                    out.append(("card", s, groups[j][1]))
                if j == i + 3 and max(form) <= 4:
                    out.append(("ip", s, groups[j][1]))
                if 7 <= total <= 15 and (j > i or first < s or text.startswith("00", s)) and max(form) <= 11:
                    closed = not bracket or ")" in text[s:groups[j][1]]
                    out.append(("phone", first if closed else s, groups[j][1]))
    return out


def fails(kind: str, s: str) -> bool:
    """Whether a proposal's values can't be what it is proposed for."""
    d = _digits(s)
    if kind == "card":
        return not (12 <= len(d) <= 19 and luhn(d))
    if kind == "ip":
        parts = _GROUP.findall(s)
        return ":" not in s and not (len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts))
    if kind == "phone":
        return not 9 <= len(d) <= 15
    return False


# -- features ----------------------------------------------------------------

# Words that speak for a kind, and against personal data.
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "master", "credit", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
}
AGAINST = ("version", "isbn", "order", "date", "no.", "id", "sha", "commit", "token", "key", "page", "line")


def _class(c: str) -> int:
    if not c:
        return 0
    if c.isspace():
        return 1
    if c.isdigit():
        return 2
    if c.isalpha():
        return 3
    return 4 if c in ".,;:!?" else 5


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a span as numbers."""
    s = text[start:end]
    left, right = text[max(0, start - AROUND):start], text[end:end + AROUND]
    d, groups = _digits(s), [len(g) for g in _GROUP.findall(s)]
    parts = [min(int(g[-4:]), 9999) for g in _GROUP.findall(s)]
    low, words = s.lower(), left.lower()
    seps = re.findall(r"[^0-9A-Za-z]+", s)
    return [
        *(float(kind == k) for k in KINDS), len(s), len(d), sum(c.isalpha() for c in s),
        len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(":"), s.count(","), s.count("(") + s.count("["),
        len(set(seps)), max(map(len, seps), default=0), s.startswith("+"), s.startswith("00"), s.startswith("("), "@" in s, " at " in low, " dot " in low,
        "at)" in low or "at]" in low or "at}" in low, "dot)" in low or "dot]" in low or "[.]" in low or "(.)" in low,
        bool(d) and luhn(d), max(parts, default=0), len(set(d)), int(d[0]) if d else -1,
        1900 <= (parts[0] if parts else 0) <= 2100, 1900 <= (parts[-1] if parts else 0) <= 2100,
        len(low.rsplit(".", 1)[-1].rsplit(" ", 1)[-1]), _class(left[-1:]), _class(right[:1]), _class(right[1:2]),
        sum(c.isdigit() for c in left[-12:]), sum(c.isdigit() for c in right[:12]), left.count("\n"),
        any(w in words for w in CUES[kind]), any(w in words for w in AGAINST),
    ]


# -- examples ----------------------------------------------------------------

def _rewritten(kind: str, s: str, rng: random.Random) -> str:
    """A base span in a form that the base patterns miss."""
    if kind == "email":
        name, host = s.split("@", 1)
        name = rng.choice([name, name.split(".")[0], name.split(".")[0] + rng.choice(("_", ".", "")) + rng.choice(("jo", "kim", "sales", "info"))])
        host = rng.choice([host, ".".join(host.split(".")[-2:])])
        at = rng.choice([" at ", " [at] ", " (at) ", "(at)", "[at]", "{at}", " @ "])
        dot = rng.choice([" dot ", " [dot] ", "(dot)", "[dot]", " . "] + ["."] * 3 * (at != " at "))
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rng.choice(["[.]", "(.)", " . ", "[dot]"]) if rng.random() < 0.8 else ",")
    d = _digits(s)
    if kind == "card":
        return rng.choice([".", "/", "_", "  ", " - "]).join(d[i:i + 4] for i in range(0, len(d), 4))
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{d}", f"00{d[:-9]} {a} {b} {c}", f"{d[:-10]}/{a}/{b}/{c}"])


def _impostor(kind: str, s: str, before: str, rng: random.Random) -> str:
    """Something in the place of a base span that is none."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = re.findall(r"[A-Za-z]+", before)[-1:] or ["look"]
    if kind == "email":
        return rng.choice([f"{word[0]} at {s.rsplit('@', 1)[-1]}", f"{word[0]} at the.{word[0]}", f"at {word[0]} dot {word[0]}"])
    date = f"{rng.randint(1900, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    day = f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2035)}"
    clock = f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}"
    numbers = " ".join(n(rng.randint(1, 5)) for _ in range(rng.randint(3, 8)))
    amounts = ", ".join(f"{rng.randint(0, 9999)}.{n(2)}" for _ in range(4))
    return rng.choice([date, day, f"{date} {clock}", f"{day} {clock}", numbers, amounts, f"{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
                       f"{rng.randint(1, 9)},{n(3)},{n(3)}.{n(2)}", n(rng.randint(7, 19)), f"{n(4)}-{n(4)} {n(4)}-{n(4)}",
                       f"{rng.randint(256, 999)}.{n(3)}.{n(2)}.{n(3)}", f"{n(2)}/{n(2)}/{n(4)}, {n(2)}/{n(2)}/{n(4)}", f"{n(6)}-{n(4)}"])


def examples(text: str) -> Iterator[tuple[int, str, int, list[float]]]:
    """(hash, kind, label, features) of the examples that a text holds; equal surroundings give equal hashes."""
    base = base_spans(text)

    def example(kind, whole, start, end, label):
        seen = whole[max(0, start - AROUND):end + AROUND]
        return xxhash.xxh64_intdigest(f"{kind}:{label}:{start - max(0, start - AROUND)}:{seen}"), kind, label, features(kind, whole, start, end)

    def covered(s, e):
        return any(s < b and a < e for _, a, b in base)

    for kind, s, e in proposals(text):
        if fails(kind, text[s:e]) and not covered(s, e):
            yield example(kind, text, s, e, 0)
    for kind, s, e in base:
        if any(a <= s and e <= b and (a, b) != (s, e) for _, a, b in base):
            continue
        left, value, right = text[max(0, s - 2 * AROUND):s], text[s:e], text[e:e + 2 * AROUND]
        yield example(kind, text, s, e, 1)
        rng = random.Random(xxhash.xxh64_intdigest(left[-AROUND:] + value + right[:AROUND]))
        for _ in range(REWRITES):
            new, other = _rewritten(kind, value, rng), _impostor(kind, value, left, rng)
            whole = kind, len(left), len(left) + len(new)
            yield example(kind, left + new + right, *whole[1:], 1)
            # Proposals of a part or of another kind are wrong, as are all within an impostor.
            for put, right_one in ((new, whole), (other, None)):
                where, end = left + put + right, len(left) + len(put)
                for k, a, b in proposals(where):
                    if len(left) - 12 <= a and len(left) < b <= end and (k, a, b) != right_one:
                        yield example(k, where, a, b, 0)


EXAMPLE = T.StructType([T.StructField("hash", T.LongType()), T.StructField("kind", T.StringType()),
                        T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])


@dataclass
class Model:
    """Trees and, per kind, the calibration of their margins."""
    trees: boosted.Trees
    steps: dict[str, tuple[np.ndarray, np.ndarray]]

    def probabilities(self, kinds: list[str], x: np.ndarray) -> np.ndarray:
        margins, out = self.trees.margins(x), np.zeros(len(kinds))
        of = np.array(kinds)
        for k, step in self.steps.items():
            out[of == k] = boosted.calibrated(step, margins[of == k])
        return out


def _bound(rows: int, most: int) -> int:
    """A hash that surely ``most`` of so many rows are under, and not many more, so that few are sorted."""
    share = (most + 12 * most ** 0.5 + 100) / max(1, rows)
    return (1 << 63) - 1 if share >= 1 else int(share * 2.0 ** 64) - (1 << 63)


def learned(df: DataFrame, text_col: str = "text", most: int = EXAMPLES) -> Model | None:
    """The model of a corpus's own examples, or None if no base span is among them.

    All texts give examples; the ``most`` distinct ones of smallest hash are fitted, half of them at most of either label.
    """
    prepare(df)

    def found(batches):
        for b in batches:
            out = [e for t in b.column("text").to_pylist() for e in examples(t or "")]
            if out:
                h, k, y, x = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(k), pa.array(y, pa.int32()),
                                                  pa.array([list(map(float, v)) for v in x])], names=EXAMPLE.names)

    every = saved(df.select(F.col(text_col).alias("text")).mapInArrow(found, EXAMPLE).dropDuplicates(["hash"]))
    number = {r["label"]: r["count"] for r in every.groupBy("label").count().collect()}
    few = [every.filter((F.col("label") == y) & (F.col("hash") <= _bound(number.get(y, 0), most // 2)))
           .orderBy("hash").limit(most // 2) for y in (0, 1)]
    rows = few[0].unionAll(few[1]).orderBy("hash").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows.column("features").to_pylist())
    kinds, held = np.array(rows.column("kind").to_pylist()), rows.column("hash").to_numpy() % 4 == 0
    w = np.where(y == 1, 1.0, max(1.0, y.sum() / (1 - y).sum()))
    if held.all() or y[~held].min() == y[~held].max():
        return None
    trees = boosted.fitted(x[~held], y[~held], w[~held])
    margins = trees.margins(x[held])
    pooled = boosted.isotonic(margins, y[held])
    steps = {}
    for k in KINDS:
        of = kinds[held] == k
        n = int(y[held][of].sum())
        steps[k] = boosted.isotonic(margins[of], y[held][of]) if min(n, of.sum() - n) >= CALIBRATION else pooled
    return Model(trees, steps)


# -- results -----------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
                                  T.StructField("probability", T.DoubleType())]))


def judged(texts: list[str], model: Model | None, least: float = PROBABILITY) -> list[list[tuple]]:
    """(kind, start, end, base, probability) of every text's spans, in order."""
    base = [base_spans(t) for t in texts]
    out = [[(*s, True, 1.0) for s in b] for b in base]
    if model is None:
        return out
    new = []
    for i, (t, b) in enumerate(zip(texts, base)):
        # Both lists are in order of start, so one look back suffices for base spans of bounded length.
        free = [s for s in set(proposals(t)) if not fails(s[0], t[s[1]:s[2]])]
        taken = np.array([(a, e) for _, a, e in b]).reshape(-1, 2)
        ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
        for s in in_order(free):
            before = int(np.searchsorted(taken[:, 0], s[2], side="left"))
            if not before or ends[before - 1] <= s[1]:
                new.append((i, s))
    if new:
        x = np.array([features(k, texts[i], a, b) for i, (k, a, b) in new], dtype=float)
        p = model.probabilities([s[0] for _, s in new], x)
        chosen: dict[int, list[tuple[int, int]]] = {}
        for j in np.lexsort((np.arange(len(p)), -p)).tolist():
            if p[j] < least:
                break
            i, (kind, a, b) = new[j]
            mine = chosen.setdefault(i, [])
            at = _place(mine, a)
            if (at == 0 or mine[at - 1][1] <= a) and (at == len(mine) or b <= mine[at][0]):
                mine.insert(at, (a, b))
                out[i].append((kind, a, b, False, float(p[j])))
    return [in_order(s) for s in out]


def _place(spans: list[tuple[int, int]], start: int) -> int:
    import bisect
    return bisect.bisect_left(spans, (start, start))


def found(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = PROBABILITY) -> DataFrame:
    """``(id, spans)`` of every row: kind, start, end, base, probability."""
    prepare(df)
    schema = T.StructType([field(df, id_col), T.StructField("spans", SPANS)])

    def mapped(batches):
        for b in batches:
            for i, j in slices(b, "text"):
                part = b.slice(i, j - i)
                spans = judged([t or "" for t in part.column("text").to_pylist()], model, least)
                values = [[dict(zip(("kind", "start", "end", "base", "probability"), s)) for s in row] for row in spans]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values, _SPANS_ARROW)], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(mapped, schema)


_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("base", pa.bool_()), ("probability", pa.float64())]))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def hidden(text: str, spans: list[tuple]) -> str:
    """The text with its spans replaced by their kinds; overlapping ones by that of the first."""
    out, at = [], 0
    for kind, s, e, *_ in in_order(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, model: Model | None, text_col: str = "text", least: float = PROBABILITY) -> DataFrame:
    """The rows of ``df``, all columns, with personal data in the text replaced; null texts stay null."""
    prepare(df)
    at = df.columns.index(text_col)

    def mapped(batches):
        for b in batches:
            for i, j in slices(b, text_col):
                part = b.slice(i, j - i)
                texts = part.column(at).to_pylist()
                new = [t if t is None else hidden(t, s) for t, s in zip(texts, judged([t or "" for t in texts], model, least))]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else c for k, c in enumerate(part.columns)],
                                                 schema=part.schema.set(at, pa.field(text_col, pa.string())))

    return df.mapInArrow(mapped, df.schema)


def digest(spans: list[tuple]) -> str:
    """SHA-256 of spans as they are listed."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, *_ in in_order(spans)).encode()).hexdigest()
