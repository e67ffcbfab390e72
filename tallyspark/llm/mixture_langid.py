"""Language identification by multilingual mixture inference.

Model: for each language, smoothed log-probabilities of hashed letter trigrams (word borders count as a letter).  A
document's words are drawn from a mixture of languages; a word's likelihood under a language is the product over its
trigrams.  Expectation-maximisation estimates the document's language proportions, and backward elimination selects its
language set: the language with the smallest proportion goes as long as the penalised log-likelihood (a constant and half
the logarithm of the number of words for each language) doesn't get worse.  The prediction is the largest remaining share.

Training counts are sums over labelled rows, of each language all or a hash-chosen share, so that about ``train_rows`` rows
at most are read (a documented bound on the classifier's sample) and a rare language loses none; the model is a table of
fixed size.  ``STEPS`` of expectation-maximisation are taken; more don't change the shares in practice.

Defined results: a null text, an empty one or one without any letter is ``und`` with score 0; ties go to the first
language by code point; without labelled rows every text is ``und``; null and repeated ids are ids like others, and
repeated rows each get their result; an empty table gives an empty table.  Long texts are read whole, in parts that end
between words; equal words of such a text are counted once, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import give_memory_back, mix, without

BUCKETS = 1 << 16
#: About so many labelled rows are read for training, chosen by a hash of their id.
TRAIN_ROWS = 40_000
SLICE = 1 << 20
STEPS = 6


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets at every letter of lower-cased texts, first letter of each word in that list, and each word's text."""
    parts = [t.lower() + "\n" for t in texts]
    points = np.frombuffer("".join(["\n", *parts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    c = np.where(letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    buckets = (mix(c[at - 1] * one + c[at] * two + c[at + 1] * three) >> np.uint64(48)).astype(np.int64)
    opens = np.flatnonzero(~letter[at - 1])
    text_end = np.cumsum([len(p) for p in parts])
    return buckets, opens, np.searchsorted(text_end, at[opens] - 1, side="right")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= SLICE):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


@dataclass
class LanguageModel:
    languages: list[str]
    #: (buckets, languages): natural logarithms of trigram probabilities.
    table: np.ndarray

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) log-likelihoods, and each word's text."""
        buckets, opens, doc = words_of(texts)
        if not len(opens):
            return np.zeros((0, len(self.languages)), np.float32), doc
        return np.add.reduceat(self.table[buckets], opens, axis=0), doc


def shares_of(numbers: dict[str, int], most: int) -> dict[str, float]:
    """Share of each language's rows so that ``most`` are taken in all: everything of the rare ones, as many of each other."""
    out, left = {}, float(most)
    for i, (k, n) in enumerate(sorted(numbers.items(), key=lambda x: (x[1], x[0]))):
        take = min(float(n), left / (len(numbers) - i))
        out[k], left = take / n, left - take
    return out


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Trigram model of the rows with a language (others are left out)."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    numbers = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    shares = shares_of(numbers, train_rows)
    if any(s < 1 for s in shares.values()):
        limit = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min((1 << 63) - 1, int(s * (1 << 63))))) for k, s in shares.items()])
        rows = rows.where(F.shiftrightunsigned(F.xxhash64(key, text), 1) <= limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, texts = np.array(b.column(1).to_pylist(), object), b.column(0).to_pylist()
            for name in dict.fromkeys(names):
                own = [texts[i] for i in np.flatnonzero(names == name)]
                have = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for i, j in _slices(own):
                    have += np.bincount(words_of(own[i:j])[0], minlength=BUCKETS)
        for name, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at])], ["lang", "bucket", "n"])

    counts = rows.select(text, lang).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).orderBy("lang").collect()
    names = sorted(r["lang"] for r in packed)
    table = np.zeros((BUCKETS, len(names)))
    for r in packed:
        table[[x["bucket"] for x in r["counts"]], names.index(r["lang"])] = [x["n"] for x in r["counts"]]
    # additive smoothing shared with the average over languages, so that a gram unseen in one language stays possible
    base = (table.sum(axis=1, keepdims=True) + 0.5) / (table.sum() + 0.5 * BUCKETS)
    table = (table + 200.0 * base) / (table.sum(axis=0, keepdims=True) + 200.0)
    return LanguageModel(names, np.log(table).astype(np.float32))


def _em(scores: np.ndarray, doc: np.ndarray, shares: np.ndarray, steps: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents, languages) after ``steps`` of expectation-maximisation, and log-likelihoods.  A share of 0 stays.
    ``times`` says how often each word counts (once by default)."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    own = doc[first]
    rows = np.diff(np.r_[first, len(doc)])
    n = (rows if times is None else np.add.reduceat(times, first))[:, None]
    top = scores.max(axis=1, keepdims=True)
    weight = np.exp(scores - top)
    at = np.repeat(np.arange(len(own)), rows)
    part = shares[own]
    for _ in range(steps):
        joint = weight * part[at]
        joint /= joint.sum(axis=1, keepdims=True) + 1e-300
        if times is not None:
            joint *= times[:, None]
        part = np.add.reduceat(joint, first, axis=0) / n
    level = np.log((weight * part[at]).sum(axis=1) + 1e-300) + top[:, 0]
    if times is not None:
        level *= times
    out, like = np.zeros_like(shares), np.zeros(len(shares))
    out[own], like[own] = part, np.add.reduceat(level, first)
    return out, like


def infer(model: LanguageModel, texts: list[str], steps: int = STEPS, penalty: float = 2.0) -> np.ndarray:
    """Language proportions of each text after selection of its language set (all 0 for a text without letters)."""
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE:
        scores, times = distinct_words(model, texts[0])
        return select(scores, np.zeros(len(scores), np.int64), 1, steps, penalty, times)
    scores, doc = model.word_scores(texts)
    return select(scores.astype(np.float64), doc, len(texts), steps, penalty)


def distinct_words(model: LanguageModel, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a long text's distinct words and how often each occurs, by parts that end between words."""
    keys, scores, times = np.zeros(0, np.uint64), np.zeros((0, len(model.languages))), np.zeros(0, np.int64)
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        part = text[at:end]
        buckets, opens, _ = words_of([part])
        if len(opens):
            place = np.arange(len(buckets)) - np.repeat(opens, np.diff(np.r_[opens, len(buckets)]))
            key = mix(np.add.reduceat(mix(buckets.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)), opens))
            own = np.add.reduceat(model.table[buckets], opens, axis=0).astype(np.float64)
            new, first, n = np.unique(key, return_index=True, return_counts=True)
            keys, at_key, of = np.unique(np.concatenate([keys, new]), return_index=True, return_inverse=True)
            scores, times = np.concatenate([scores, own[first]])[at_key], np.bincount(of, np.concatenate([times, n])).astype(np.int64)
        at = end
    return scores, times


def select(scores: np.ndarray, doc: np.ndarray, n_docs: int, steps: int, penalty: float, times: np.ndarray | None = None) -> np.ndarray:
    """Proportions of each document from its words' scores: expectation-maximisation, and backward elimination of languages."""
    n_lang = scores.shape[1]
    if not len(doc) or not n_lang:
        return np.zeros((n_docs, n_lang))
    words = np.bincount(doc, times, minlength=n_docs)
    cost = penalty + 0.5 * np.log(words + 1)
    shares, like = _em(scores, doc, np.full((n_docs, n_lang), 1 / n_lang), steps, times)
    value = like - cost * (shares > 0).sum(axis=1)
    live = words > 0
    for _ in range(n_lang - 1):
        take = live[doc]
        if not take.any():
            break
        sub, sub_doc, sub_times = scores[take], doc[take], None if times is None else times[take]
        trial = np.where(shares > 0, shares, np.inf)
        drop = n_lang - 1 - np.argmin(trial[:, ::-1], axis=1)
        trial = shares.copy()
        trial[np.arange(n_docs), drop] = 0
        total = trial.sum(axis=1, keepdims=True)
        trial = np.where(total > 0, trial / np.where(total > 0, total, 1), 0)
        several = (trial > 0).sum(axis=1).max() > 1
        trial, like = _em(sub, sub_doc, trial, steps if several else 0, sub_times)
        got = like - cost * (trial > 0).sum(axis=1)
        better = live & (got >= value)
        shares[better], value[better] = trial[better], got[better]
        live = better & ((shares > 0).sum(axis=1) > 1)
    return shares


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, names: tuple[str, ...] = ("lang_pred", "score", "languages", "proportions")) -> DataFrame:
    """``keep`` columns (all by default) with lang_pred, score (its proportion), languages and proportions (the selected set,
    largest first), under ``names``: a map without shuffle; the model is broadcast.  An input column of such a name gives way."""
    new = list(names)
    keep = without(docs.columns if keep is None else keep, new)
    schema = docs.select(*keep).schema.add(new[0], "string").add(new[1], "double").add(new[2], T.ArrayType(T.StringType())).add(new[3], T.ArrayType(T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = [text, *(c for c in keep if c != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            first, best, sets, parts = [], [], [], []
            for i, j in _slices(texts):
                shares = infer(m, texts[i:j])
                for row in shares:
                    order = [k for k in np.argsort(-row, kind="stable") if row[k] > 0] if len(row) else []
                    first.append(m.languages[order[0]] if order else "und")
                    best.append(float(min(1.0, row[order[0]])) if order else 0.0)
                    sets.append([m.languages[k] for k in order])
                    parts.append([float(row[k]) for k in order])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(first, pa.string()), pa.array(best, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], [*keep, *new])

    return docs.select(*read).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows kept out of training: the CRC-32 of the id as text leaves 2 when divided by 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % 4 == 2, F.lit(False))
