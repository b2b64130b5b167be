"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and set between blanks; their 1- to 3-grams are hashed
to ``BUCKETS`` features. Training sums the features' counts per language over
all labelled texts (each task adds up its own first). The matrix of smoothed
log-probabilities, buckets by languages, is broadcast: its size depends on
the number of languages only and is checked. More languages than
``BROADCAST_BYTES`` holds are learned and scored in blocks that it does hold,
one after the other; the best language and the sum of the scores of each row
are carried from block to block in a stored table. Batches of texts are scored as
sparse rows, with one gather and one weighted ``bincount`` per language.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctsig.llm.common import codepoints, prepare, rolling, scratch, slices

BITS = 15
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
SMOOTHING = 0.1
UNKNOWN = "und"
BROADCAST_BYTES = 64_000_000
MOST_LANGS = BROADCAST_BYTES // (BUCKETS * 8)
LETTER = re.compile(r"[^\W\d_]")  # and some other signs, such as fractions


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, bucket)`` of all n-grams of the texts, one size at a time; none crosses two texts."""
    marked = [f" {t.lower()} " for t in texts]
    codes = codepoints("".join(marked))
    length = np.array([len(t) for t in marked], np.int64)
    row = np.repeat(np.arange(len(texts)), length)
    for n in SIZES:
        h = rolling(codes, n)
        k = len(h)
        same = row[:k] == row[n - 1:n - 1 + k]
        yield row[:k][same], (h[same] >> np.uint64(64 - BITS)).astype(np.int64)


def feature_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, bucket, n)`` over all rows; bucket -1 counts the documents."""
    prepare(docs)

    def rows(total):
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(c[at])],
                names=["lang", "bucket", "n"])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in ((x, min(x + MOST_LANGS, b)) for a, b in slices(batch, "text") for x in range(a, b, MOST_LANGS)):
                part = batch.slice(a, b - a)
                texts, langs = part.column(0).to_pylist(), np.array(part.column(1).to_pylist(), object)
                names, code = np.unique(langs.astype(str), return_inverse=True)
                counts = np.zeros((len(names), BUCKETS + 1), np.int64)
                counts[:, BUCKETS] = np.bincount(code, minlength=len(names))
                for row, bucket in features(texts):
                    flat = np.bincount(code[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                    counts[:, :BUCKETS] += flat.reshape(len(names), BUCKETS)
                for name, c in zip(names.tolist(), counts):
                    total[name] = total[name] + c if name in total else c
                if len(total) > MOST_LANGS:
                    yield from rows(total)
                    total = {}
        yield from rows(total)

    return (docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
            .mapInArrow(run, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    """Languages in order, log priors, and log-probabilities by language and bucket.

    ``typical`` and ``spread`` are the mean and standard deviation of the log-probability of an n-gram
    of a language's own training texts.
    """

    langs: list[str]
    prior: np.ndarray
    log_p: np.ndarray
    typical: np.ndarray
    spread: np.ndarray

    def excess(self, texts: list[str | None]) -> np.ndarray:
        """How far each text's mean log-probability of an n-gram lies above the likeliest language's typical one.

        Three standard errors of a mean over the text's n-grams are added, so that short texts are not
        judged by a few n-grams. The posterior cannot tell this: some learned language always is the likeliest.
        """
        score, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for row, bucket in features([t or "" for t in texts]):
            n += np.bincount(row, minlength=len(texts))
            for k in range(len(self.langs)):
                score[:, k] += np.bincount(row, weights=self.log_p[k][bucket], minlength=len(texts))
        best = (score + self.prior).argmax(axis=1)
        n = np.maximum(n, 1)
        return score[np.arange(len(texts)), best] / n - self.typical[best] + 3 * self.spread[best] / np.sqrt(n)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log prior and likelihood, texts by languages."""
        score = np.tile(self.prior, (len(texts), 1))
        for row, bucket in features([t or "" for t in texts]):
            for k in range(len(self.langs)):
                score[:, k] += np.bincount(row, weights=self.log_p[k][bucket], minlength=len(texts))
        return score

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; ``und`` and 0 without letters or languages."""
        score = self.scores(texts)
        known = np.array([bool(self.langs) and has_letter(t) for t in texts], bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = score.argmax(axis=1)
        posterior = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, posterior, 0.0)


@dataclass
class Blocks:
    """More languages than one matrix may hold: stored counts, and the languages of each block in order."""

    counts: DataFrame
    langs: list[list[str]]
    documents: int
    smoothing: float

    def models(self) -> Iterator[Model]:
        for langs in self.langs:
            part = self.counts.filter(F.col("lang").between(langs[0], langs[-1]))
            yield _model(part, self.smoothing, self.documents)

    def judged(self, docs: DataFrame, text_col: str) -> DataFrame:
        """``docs`` with ``__lang``, ``__score`` and ``__excess`` (``Model.excess``) over all blocks."""
        spark = prepare(docs)
        kept = list(docs.schema)
        schema = T.StructType([*kept, T.StructField("__lang", T.StringType()),
                               *(T.StructField(x, T.DoubleType()) for x in ("__top", "__sum", "__excess"))])
        out = docs.select("*", F.lit(UNKNOWN).alias("__lang"), F.lit(-math.inf).alias("__top"),
                          F.lit(-math.inf).alias("__sum"), F.lit(0.0).alias("__excess"))
        for model in self.models():
            sent = spark.sparkContext.broadcast(model)

            def run(batches, sent=sent):
                m = sent.value
                for batch in batches:
                    for a, b in slices(batch, text_col):
                        part = batch.slice(a, b - a)
                        texts = part.column(text_col).to_pylist()
                        score = m.scores(texts)
                        best = score.argmax(axis=1)
                        own = score.max(axis=1)
                        top, total, excess = (part.column(x).to_numpy() for x in ("__top", "__sum", "__excess"))
                        better = own > top
                        names = np.where(better, np.array(m.langs, object)[best], part.column("__lang").to_pylist())
                        sums = own + np.log(np.exp(score - own[:, None]).sum(axis=1))
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(f.name) for f in kept), pa.array(names.tolist(), pa.string()),
                             pa.array(np.maximum(top, own)), pa.array(np.logaddexp(total, sums)),
                             pa.array(np.where(better, m.excess(texts), excess))], names=schema.names)

            path = scratch(spark, "languages")
            out.mapInArrow(run, schema).write.parquet(path)
            out = spark.read.schema(schema).parquet(path)

        def last(batches):
            for batch in batches:
                known = [has_letter(t) for t in batch.column(text_col).to_pylist()]
                score = np.exp(batch.column("__top").to_numpy() - batch.column("__sum").to_numpy())
                names = [x if ok else UNKNOWN for x, ok in zip(batch.column("__lang").to_pylist(), known)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name) for f in kept), pa.array(names, pa.string()),
                     pa.array(np.where(known, score, 0.0)), batch.column("__excess")],
                    names=[*(f.name for f in kept), "__lang", "__score", "__excess"])

        return out.mapInArrow(last, T.StructType([*kept, T.StructField("__lang", T.StringType()),
                                                  T.StructField("__score", T.DoubleType()),
                                                  T.StructField("__excess", T.DoubleType())]))


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
            smoothing: float = SMOOTHING) -> Model | Blocks:
    """Learn from all rows with a text and a language."""
    n = docs.select(lang_col).dropna().distinct().count()
    counts = feature_counts(docs, text_col, lang_col)
    if n <= MOST_LANGS:
        return _model(counts, smoothing)
    path = scratch(docs.sparkSession, "language-counts")
    counts.write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    per = counts.filter("bucket = -1")
    langs = sorted((r.lang for r in per.select("lang").toLocalIterator()), key=str.encode)
    documents = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Blocks(counts, [langs[i:i + MOST_LANGS] for i in range(0, len(langs), MOST_LANGS)], documents, smoothing)


def _model(counts: DataFrame, smoothing: float, total: int | None = None) -> Model:
    """The model of ``feature_counts``; ``total``: documents of all languages, if these are not all."""
    t = counts.toArrow()
    coded = pa.concat_arrays([pa.array([], pa.string()), *t.column("lang").chunks]).dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    table = np.zeros((len(langs), BUCKETS + 1))
    place = np.array([langs.index(x) for x in names], dtype=np.int64)
    if len(coded):
        table[place[coded.indices.to_numpy()], t.column("bucket").to_numpy()] = t.column("n").to_numpy()  # -1 is the last column
    documents, grams = table[:, BUCKETS], table[:, :BUCKETS] + smoothing
    log_p = np.log(grams / grams.sum(axis=1, keepdims=True))
    share = table[:, :BUCKETS] / np.maximum(table[:, :BUCKETS].sum(axis=1, keepdims=True), 1)
    typical = (share * log_p).sum(axis=1)
    spread = np.sqrt((share * (log_p - typical[:, None]) ** 2).sum(axis=1))
    return Model(langs, np.log(documents / max(1, total or documents.sum())), log_p, typical, spread)


def predicted(docs: DataFrame, model: Model | Blocks, text_col: str = "text", lang_out: str = "lang_pred",
              score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability.

    Texts are read whole and alone: no other column is an input. Null, empty
    and letterless texts are ``und`` with score 0. Repeated rows keep a row
    each; columns of the two names are replaced.
    """
    spark = prepare(docs)
    if isinstance(model, Blocks):
        return (model.judged(docs.drop(*{lang_out, score_out} - {text_col}), text_col)
                .withColumnsRenamed({"__lang": lang_out, "__score": score_out}).drop("__excess"))
    sent = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in (lang_out, score_out)]
    schema = T.StructType([*kept, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, text_col):
                part = batch.slice(a, b - a)
                lang, score = sent.value.predict(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score)],
                    names=schema.names)

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | Blocks, least: float = 0.5, text_col: str = "text",
             below: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a posterior of ``least`` or more; all columns are kept.

    With ``below``, the text's n-grams must also be like that language's: their mean log-probability
    not more than ``below`` under the typical one (``Model.excess``). A model without languages can
    reject none, so then all texts with letters are kept.
    """
    spark = prepare(docs)
    if isinstance(model, Blocks):
        out = model.judged(docs, text_col).filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least))
        return (out if below is None else out.filter(F.col("__excess") >= -below)).drop("__lang", "__score", "__excess")
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for a, b in slices(batch, text_col):
                part = batch.slice(a, b - a)
                texts = part.column(text_col).to_pylist()
                if m.langs:
                    lang, score = m.predict(texts)
                    keep = (np.array(lang, object) != UNKNOWN) & (score >= least)
                    if below is not None:
                        at = np.flatnonzero(keep)
                        keep[at] = m.excess([texts[i] for i in at]) >= -below
                else:
                    keep = np.array([has_letter(t) for t in texts], bool)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
