"""Column -> Column text helpers with Python ``str``/``re`` semantics.

Spark evaluates Java regexes. Python's ``\\w``, ``\\b``, ``\\s``, ``.``
and ``$`` differ from Java's defaults, so patterns are written with
explicit, portable classes:

  W   word character      [\\p{L}\\p{N}_]     (Python str ``\\w``)
  WS  whitespace          the 29 code points ``str.split()`` splits on
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from acctsig.functions.charstats import Found

# Character classes (bodies, without the brackets).
W_BODY = r"\p{L}\p{N}_"
WS_BODY = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same whitespace set as literal characters (for trim functions).
WS_CHARS = "".join(chr(c) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0),
                                       (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                                       (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
                   for c in range(a, b + 1))
W = f"[{W_BODY}]"
NOT_W = f"[^{W_BODY}]"
WS = f"[{WS_BODY}]"
NOT_WS = f"[^{WS_BODY}]"
BOUNDARY = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite a Python ``re`` pattern into a Java regex with equal meaning.

    Handles the escapes the fixed pattern lists use: ``\\b \\w \\W \\s \\S
    \\d \\uXXXX \\UXXXXXXXX``, ``.`` (any char but newline) and ``$`` (end,
    or before a final newline). Everything else passes through.
    """
    out: list[str] = []
    i, n, in_class = 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n and pattern[i + 1] == "b" and not in_class:
            nxt = pattern[i + 2] if i + 2 < n else ""
            after = pattern[i + 3] if i + 3 < n else ""
            if _word_lit(nxt) and after not in "?*+{":
                # literal first, then look back past it: most positions fail
                # on one character compare instead of a class look-behind
                out.append(nxt + f"(?<!{W}[\\s\\S])")
                i += 3
                continue
            out.append(_boundary(pattern, i))
            i += 2
            continue
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            if e == "u":
                out.append(r"\x{" + pattern[i + 2:i + 6] + "}")
                i += 6
                continue
            if e == "U":
                out.append(r"\x{" + pattern[i + 2:i + 10].lstrip("0") + "}")
                i += 10
                continue
            if in_class:
                out.append({"w": W_BODY, "s": WS_BODY, "d": r"\p{Nd}"}.get(e, c + e))
            else:
                out.append({"b": BOUNDARY, "w": W, "W": NOT_W, "s": WS, "S": NOT_WS,
                            "d": r"\p{Nd}"}.get(e, c + e))
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("^")
                i += 1
        elif c == ".":
            out.append(r"[^\n]")
        elif c == "$":
            out.append(r"(?=\n?\z)")
        else:
            out.append(c)
        i += 1
    body = "".join(out)
    return f"(?iu:{body})" if ignore_case else body


def _word_lit(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _alternatives(pattern: str, open_i: int) -> list[str]:
    inner = pattern[open_i + 1:_group_end(pattern, open_i)]
    if inner.startswith("?:"):
        inner = inner[2:]
    return _split_top(inner)


def _boundary(pattern: str, i: int) -> str:
    """Python ``\\b`` at ``pattern[i]``, one-sided when a neighbour is fixed.

    Next to a literal word character only the other side needs a test, and
    a one-sided look-around is several times cheaper per position.
    """
    nxt = pattern[i + 2] if i + 2 < len(pattern) else ""
    if _word_lit(nxt):
        return f"(?<!{W})"
    if nxt == "(" and all(a and _word_lit(a[0]) for a in _alternatives(pattern, i + 2)):
        return f"(?<!{W})"
    prev = pattern[i - 1] if i >= 1 else ""
    escaped = i >= 2 and pattern[i - 2] == "\\"
    if _word_lit(prev) and not escaped:
        return f"(?!{W})"
    if prev == ")":
        depth, j = 0, i - 1
        while j >= 0:
            if pattern[j] == ")":
                depth += 1
            elif pattern[j] == "(":
                depth -= 1
                if depth == 0:
                    break
            j -= 1
        if all(a and _word_lit(a[-1]) for a in _alternatives(pattern, j)):
            return f"(?!{W})"
    return BOUNDARY


def any_of(patterns: list[str]) -> str:
    """One alternation matching when any of the patterns matches."""
    return "|".join(f"(?:{p})" for p in patterns)


def rlike(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Python ``bool(re.search(pattern, s[, re.I]))``."""
    return col.rlike(java_regex(pattern, ignore_case))


def count_matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Python ``len(re.findall(pattern, s))`` (non-overlapping)."""
    return F.regexp_count(col, F.lit(java_regex(pattern, ignore_case)))


def count_char(col: Column, ch: str) -> Column:
    """Python ``s.count(ch)`` for a single character."""
    return F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))


def tokens(col: Column) -> Column:
    """Python ``s.split()``: runs of non-whitespace, no empty tokens."""
    return F.array_remove(F.split(col, f"{WS}+"), "")


def word_runs(col: Column, min_len: int = 2) -> Column:
    """Runs of >= ``min_len`` word characters (the TF-IDF token rule)."""
    return F.regexp_extract_all(col, F.lit(f"{W}{{{min_len},}}"), 0)


def is_blank(col: Column) -> Column:
    """Python ``not s.strip()``."""
    return ~col.rlike(NOT_WS)


def nz(col: Column | str, default=0) -> Column:
    """NULL -> default."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(default))


def safe_div(num: Column, den: Column) -> Column:
    """num / max(den, 1) as double (ANSI-safe)."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(1.0))


# ---------------------------------------------------------------------------
# Literal prefilter
#
# A regex pass over whole documents costs far more than a byte search, and
# most posts contain none of a pattern's words. ``required_literals`` finds
# literals of which every match must contain at least one; the regex then
# only runs on posts containing one of them. Spark evaluates ``a AND b``
# lazily in generated code, so the regex is skipped when the gate is false.
# ---------------------------------------------------------------------------

_QUANT_OPTIONAL = "?*{"
# Characters whose case-insensitive match is not found by lower() + contains:
# long s, dotless i, and the combining dot that lower('İ') leaves behind.
_EXOTIC_FOLDS = ["ſ", "ı", "̇"]


def _split_top(p: str) -> list[str]:
    """Split at top-level ``|`` (outside groups and classes)."""
    out, depth, cur, i, in_class = [], 0, [], 0, False
    while i < len(p):
        c = p[i]
        if c == "\\":
            cur.append(p[i:i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append("".join(cur))
            cur = []
            i += 1
            continue
        cur.append(c)
        i += 1
    out.append("".join(cur))
    return out


def _group_end(p: str, i: int) -> int:
    depth, in_class = 0, False
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise ValueError(f"unbalanced group in {p!r}")


def required_literals(p: str) -> list[str] | None:
    """Literals one of which every match of ``p`` contains, or None."""
    alts = _split_top(p)
    if len(alts) > 1:
        out: list[str] = []
        for a in alts:
            k = required_literals(a)
            if not k:
                return None
            out += k
        return out
    cands: list[list[str]] = []
    run: list[str] = []

    def flush():
        if run:
            cands.append(["".join(run)])
            run.clear()

    i = 0
    while i < len(p):
        c = p[i]
        nxt = p[i + 1] if i + 1 < len(p) else ""
        if c == "\\":
            e = p[i + 1]
            if e in "bBAzZswdSWD" or e in "uUx":
                flush()
                if e in "uU":
                    i += 6 if e == "u" else 10
                    continue
            else:
                run.append(e)
            i += 2
            continue
        if c == "[":
            flush()
            j = i + 1
            while p[j] != "]" or j == i + 1:
                j += 2 if p[j] == "\\" else 1
            i = j + 1
            continue
        if c == "(":
            j = _group_end(p, i)
            inner = p[i + 1:j]
            if inner.startswith("?:"):
                inner = inner[2:]
            flush()
            after = p[j + 1] if j + 1 < len(p) else ""
            if after == "" or after not in _QUANT_OPTIONAL:
                sub = required_literals(inner)
                if sub:
                    cands.append(sub)
            i = j + 1
            continue
        if c in _QUANT_OPTIONAL:
            if run:
                run.pop()
            flush()
            if c == "{":
                i = p.index("}", i)
            i += 1
            continue
        if c in "+.^$)":
            flush()
            i += 1
            continue
        if nxt and nxt in _QUANT_OPTIONAL:
            flush()
            i += 1
            continue
        run.append(c)
        i += 1
    flush()
    if not cands:
        return None
    return max(cands, key=lambda ks: (min(len(k) for k in ks), -len(ks)))


def lowered(col: Column) -> Column:
    return F.lower(col)


def spelled_out(p: str, most: int = 16) -> list[str] | None:
    """All texts that ``p`` matches, if it is made of plain characters and groups of alternatives only and these are few."""
    if re.search(r"[\\\[\]?*+{}.^$]", p.replace("(?:", "(")):
        return None
    out = []
    for a in _split_top(p):
        found, i = [""], 0
        while i < len(a):
            if a[i] == "(":
                j = _group_end(a, i)
                mine = spelled_out(a[i + 1:j].removeprefix("?:"), most)
                if mine is None:
                    return None
                found, i = [x + y for x in found for y in mine], j + 1
            else:
                found, i = [x + a[i] for x in found], i + 1
        out += found
    return out if len(out) <= most else None


def gate_keys(p: str) -> list[str] | None:
    """``required_literals``, or whole matches where those are short, so that many texts would have them."""
    keys = required_literals(p)
    if keys and min(map(len, keys)) >= 6:
        return keys
    return spelled_out(p) or keys


def column(low: Column | Found) -> Column:
    """The lower-cased text itself."""
    return low.column if isinstance(low, Found) else low


def has_exotic_folds(low: Column) -> Column:
    """Whether a lower-cased text has a case fold that ``lower()`` cannot see."""
    out = None
    for ch in _EXOTIC_FOLDS:
        g = low.contains(ch)
        out = g if out is None else out | g
    return out


def gated_rlike(text: Column, low: Column, pattern: str,
                ignore_case: bool = False, exotic: Column | None = None) -> Column:
    """Exact ``re.search`` test, run only when a required literal is present.

    ``low`` must be ``lower(text)`` when ``ignore_case`` (keys are
    lower-cased), else ``text`` itself. ``exotic`` is a column with
    ``has_exotic_folds(low)``, so that not each pattern looks for them.
    """
    rx = text.rlike(java_regex(pattern, ignore_case))
    keys = gate_keys(pattern)
    if not keys:
        return rx
    if ignore_case:
        keys = sorted({k.lower() for k in keys})
    gate = None
    for k in keys:
        g = low.contains(k)
        gate = g if gate is None else (gate | g)
    if ignore_case:
        gate = gate | (has_exotic_folds(low) if exotic is None else exotic)
    return gate & rx


def alternatives(p: str) -> list[str]:
    """Split a search pattern into alternatives with the same meaning for
    ``re.search``: top-level ``|``, a group spanning the whole pattern, and
    ``\\b(a|b)\\b`` (boundaries distributed over the words)."""
    top = _split_top(p)
    if len(top) > 1:
        return [a for t in top for a in alternatives(t)]
    pre, post, body = "", "", p
    if body.startswith(r"\b("):
        pre, body = r"\b", body[2:]
    if body.endswith(r")\b"):
        post, body = r"\b", body[:-2]
    if body.startswith("(") and _group_end(body, 0) == len(body) - 1:
        inner = body[1:-1]
        if inner.startswith("?:"):
            inner = inner[2:]
        alts = _split_top(inner)
        if len(alts) > 1:
            return [a for x in alts for a in alternatives(pre + x + post)]
    return [p]


def gate_literals(patterns: list[str], ignore_case: bool = True) -> list[str]:
    """The literals by which ``gated_any`` tells whether a regex has to run."""
    keys = [k for p in patterns for a in alternatives(p) for k in gate_keys(a) or []]
    return [k.lower() for k in keys] if ignore_case else keys


def pure_words(pattern: str) -> tuple[list[str], list[str]]:
    """The alternatives of a pattern ``\\b(w1|w2|...)\\b``: words of word characters only, lower-cased, and the others."""
    pure, other = [], []
    for a in alternatives(pattern):
        w = a[2:-2] if a.startswith(r"\b") and a.endswith(r"\b") else None
        if w is not None and re.fullmatch(r"\w+", w):
            pure.append(w.lower())
        else:
            other.append(a)
    return pure, other


def gated_any(text: Column, low: Column, patterns: list[str],
              ignore_case: bool = False, exotic: Column | None = None) -> Column:
    """``any(re.search(p, s) for p in patterns)``: every alternative of
    every pattern is its own small regex behind its own literal gate."""
    out = None
    for p in patterns:
        for a in alternatives(p):
            g = gated_rlike(text, low, a, ignore_case, exotic)
            out = g if out is None else (out | g)
    return out


def word_set_any(text: Column, low: Column, pattern: str, exotic: Column | None = None) -> Column:
    """Case-insensitive ``re.search`` for a pattern ``\\b(w1|w2|...)\\b``.

    For alternatives made only of word characters, a match exists exactly
    when some maximal word-character run of the lower-cased text equals the
    word, which is one extraction and a hash-set overlap instead of one
    regex per word, or was found with the per-character statistics (``charstats.Found``). Other alternatives keep their gated regex, and a post
    with a case fold ``lower()`` cannot see (long s, dotless i, a combining
    dot) uses the gated regexes for every alternative.
    """
    pure, other = pure_words(pattern)
    if not pure:
        return gated_any(text, low, [pattern], True, exotic)
    if isinstance(low, Found) and set(pure) == set(low.words):  # sought already
        fast = low.word_hit()
    else:
        words = F.array(*[F.lit(w) for w in pure])
        runs = F.regexp_extract_all(column(low), F.lit(f"{W}+"), 0)
        fast = F.arrays_overlap(runs, words)
    if other:
        fast = fast | gated_any(text, low, other, True, exotic)
    if exotic is None:
        exotic = has_exotic_folds(low)
    return F.when(exotic, gated_any(text, low, [pattern], True, exotic)).otherwise(fast)
