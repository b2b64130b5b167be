"""Tokenizing by pieces that the tokenizers split alike.

A tokenizer encodes the parts that its pre-tokenizer makes one by one. Both
public byte-pair tokenizers split before a run of blanks and line feeds that
follows another character, between a letter or digit and ASCII punctuation, and
after a line feed that stands before a word. Cut there, a text's pieces can be
encoded by themselves with the same ids, so a worker encodes each part
once and remembers it. Where a tokenizer drops what lies between matches of a
pattern, a text of ASCII and Latin letters is cut by that pattern itself, once it is
folded as the tokenizer does. What counts is the normalised text: a letter whose
normalised form ends in a combining mark is no place to cut after. What a tokenizer drops (blanks) or folds (case) before
it looks at a word is folded for ASCII parts here, too, so that more of them
are alike.

The argument needs every other white space and all control and format
characters, on which libraries differ, to be absent; a text that has one is
encoded as a whole. Strings of special tokens are never cut. The tests
compare both ways.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import compress, repeat
from operator import is_

import numpy as np

PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# Between a letter or digit and ASCII punctuation other than an apostrophe; after a single line feed.
PART = re.compile(r"(?<=[^\W_])(?=[!-&(-/:-@\[-`{-~])|(?<=^\n)(?=[^ \n])")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Printable ASCII, line feeds, and Latin letters, signs and digits that have a lower case of one character.
PLAIN = re.compile(r"[\n\x20-\x7E\xA1-\xAC\xAE-\u012F\u0131-\u017F]*")
SPECIAL = "<|"
# Remembered strings of one worker; beyond that it starts anew (results don't change).
REMEMBERED = 1_200_000
_BATCH = 8_192
_JOINED = 512  # parts that are encoded as one text
_ENDS = frozenset("!-.,:;?")


def load(path: str):
    """The library's tokenizer for a vocabulary file: tokenizers for .json, sentencepiece for .model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def version(path: str) -> str:
    """Digest of the vocabulary file, which tells tokenizer versions apart."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Texts to id lists by the library, without added special tokens."""
    tok = load(path)
    if path.endswith(".model"):
        return lambda texts: tok.encode(texts, num_threads=1)
    return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _steps(config: dict | None, inner: str) -> list[dict]:
    return config.get(inner, [config]) if config else []


def folding(path: str) -> tuple[bool, bool]:
    """Whether the tokenizer lower-cases, and whether it drops what lies between words."""
    config = json.loads(load(path).to_str())
    lower = any(s["type"] == "Lowercase" for s in _steps(config["normalizer"], "normalizers"))
    drops = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]
                for s in _steps(config["pre_tokenizer"], "pretokenizers"))
    return lower, drops


def matcher(path: str) -> re.Pattern | None:
    """The pattern whose matches are all that the tokenizer keeps of a lower-cased text of ``PLAIN`` characters, if it has one.

    A match encoded by itself is matched as a whole. NFC leaves these characters as they are.
    """
    config = json.loads(load(path).to_str())
    steps = _steps(config["pre_tokenizer"], "pretokenizers")
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if (not steps or steps[0]["type"] != "Split" or steps[0]["pattern"].get("Regex") != SPLIT
            or any(s["type"] != "ByteLevel" or s["add_prefix_space"] or s["use_regex"] for s in steps[1:])
            or any(s["type"] not in ("NFC", "Lowercase") and s != spaces for s in _steps(config["normalizer"], "normalizers"))
            or any(SPECIAL not in t["content"] for t in config["added_tokens"])):
        return None
    kinds = {k: "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == k and PLAIN.fullmatch(c)) for k in "LN"}
    # Letters first, which most matches are of: no other alternative begins with one.
    ordered = "|".join([r"[\p{L}]+", *(a for a in SPLIT.split("|") if a != r"[\p{L}]+")])
    return re.compile(ordered.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]))


def word_ends(path: str) -> np.ndarray | None:
    """Per id whether its token ends a word, for a byte-pair vocabulary that marks the last token of each."""
    model = json.loads(load(path).to_str())["model"]
    if model["type"] != "BPE" or not (mark := model["end_of_word_suffix"]):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for t, i in model["vocab"].items() if t.endswith(mark)]] = True
    return ends


class Pieces:
    """Per-worker memo of a function of a part's ids; ``of(texts)`` gives each text's value.

    ``value`` maps a part's ids to what is kept, ``join`` those of the parts
    to that of the whole.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], join: Callable[[Iterable], object]):
        self.encode, self.value, self.join = encoder(path), value, join
        self.whole_only = path.endswith(".model")
        self.lower, self.drops = (False, False) if self.whole_only else folding(path)
        self.tok = load(path)
        self.matches = matcher(path) if self.lower and self.drops else None
        self.ends = word_ends(path) if self.drops else None
        normalizer = None if self.whole_only else self.tok.normalizer
        self.normalized = normalizer.normalize_str if normalizer else str
        self.sound: dict[str, bool] = {}
        self.known: dict[str, object] = {}  # pieces and parts alike: the value of a string's own ids

    def _ends_well(self, c: str) -> bool:
        """Whether the normalised form of a letter or digit ends in one, so that a cut may follow."""
        if c not in self.sound:
            form = self.normalized(c)
            self.sound[c] = bool(form) and form[-1].isalnum()
        return self.sound[c]

    def _cut(self, text: str) -> list[str] | None:
        if not text.replace("\n", " ").isprintable():
            return None
        return text.split() if self.drops else PIECE.findall(text)

    def _folded(self, piece: str) -> list[str]:
        if SPECIAL in piece:
            return [piece]
        split = PART.split(piece)
        if not piece.isascii() and not all(p[-1].isascii() or self._ends_well(p[-1]) for p in split[:-1]):
            return [piece]
        return [p.lower() if p.isascii() else p for p in split] if self.lower else split

    def _of_words(self, words: list[str]) -> list[list[int]]:
        """The ids of letters-and-digits words, encoded as one text with blanks, which are dropped, between them."""
        text = " ".join(words)
        if self.ends is not None:
            ids = self.encode([text])[0]
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(words) and "".join(words).isalpha():  # as many as words, each with one part
                return [ids[a:b] for a, b in zip([0, *cuts], cuts)]
        found = self.tok.encode(text, add_special_tokens=False)
        ids, at = found.ids, np.array([o[0] for o in found.offsets], dtype=np.int64)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        cuts = np.searchsorted(at, starts).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, fresh: set[str], parts: set[str]) -> None:
        """Remember pieces, and parts that need no cutting, that are not known yet."""
        known, lower = self.known, self.lower
        whole, split, new = [], [], parts
        for p in fresh:
            if p.isalnum():  # one part
                if lower and p.isascii() and (q := p.lower()) != p:
                    whole.append((p, q))
                    new.add(q)
                else:
                    new.add(p)
            elif p[-1] in _ENDS and (head := p[:-1]).isalnum() and (head[-1].isascii() or self._ends_well(head[-1])):
                q = [head.lower() if lower and head.isascii() else head, p[-1]]
                split.append((p, q))
                new.update(q)
            else:
                q = self._folded(p)
                if q != [p]:
                    split.append((p, q))
                new.update(q)
        new = [p for p in new if p not in known]  # not a set difference, which would look through all that is known
        words = [p for p in new if p.isalnum()] if self.drops else []
        alone = [p for p in new if not p.isalnum()] if self.drops else new
        for i in range(0, len(words), _JOINED):
            part = words[i:i + _JOINED]
            known.update(zip(part, map(self.value, self._of_words(part))))
        for i in range(0, len(alone), _BATCH):
            part = alone[i:i + _BATCH]
            known.update(zip(part, map(self.value, self.encode(part))))
        for p, q in whole:
            known[p] = known[q]
        for p, q in split:
            known[p] = self.join([known[x] for x in q])

    def of(self, texts: list[str]) -> list[object]:
        if self.whole_only:
            return list(map(self.value, self.encode(texts)))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the memo is large to look through
        try:
            return self._of(texts)
        finally:
            if collects:
                gc.enable()

    def _of(self, texts: list[str]) -> list[object]:
        get, out = self.known.get, []
        matches, plain = self.matches, PLAIN.fullmatch
        by_match = [matches is not None and SPECIAL not in t and plain(t) is not None for t in texts]
        cut = [matches.findall(t.lower()) if m else self._cut(t) for m, t in zip(by_match, texts)]
        found = [None if row is None else list(map(get, row)) for row in cut]
        gaps = [list(compress(row, map(is_, values, repeat(None)))) if row and None in values else [] for row, values in zip(cut, found)]
        self._learn(set().union(*(g for m, g in zip(by_match, gaps) if not m)), set().union(*compress(gaps, by_match)))
        for text, values, gap in zip(texts, found, gaps):
            if values is None:
                out.append(self.value(self.encode([text])[0]))
            else:
                rest = map(get, gap)
                out.append(self.join([next(rest) if v is None else v for v in values] if gap else values))
        return out


_WORKERS: dict[tuple[str, str], Pieces] = {}


def worker(path: str, kind: str, value: Callable[[list[int]], object], join: Callable[[Iterable], object]) -> Pieces:
    """The memo of this Python worker for a vocabulary file and kind of value."""
    if (path, kind) not in _WORKERS:
        _WORKERS[path, kind] = Pieces(path, value, join)
    return _WORKERS[path, kind]
