"""Language identification of documents as mixtures of languages.

Learning counts byte trigrams of words by language.  A word's likelihood in a
language is the product of its trigram probabilities; a document's language
proportions are the mixture weights that expectation-maximisation finds for its
words.  Languages enter a document's set in the order of their proportions as long
as the penalised likelihood grows.

The model has a float for each of 262,144 trigrams and language; that bounds
what is gathered and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, giving_back

#: Symbols of words: 0 ends a word, a to z, and the bytes of other letters folded onto the rest.
SYMBOLS = 64
TRIGRAMS = SYMBOLS**3
SMOOTHING = 0.5
#: UTF-8 bytes worked on at once; a longer document is worked on alone.
BATCH_BYTES = 1 << 20
UNKNOWN = "und"
#: Expectation-maximisation goes on until proportions change by no more; the rounds are a guard that texts do not reach.
TOLERANCE, ROUNDS = 1e-3, 1000
#: Languages that a model can have: its size is a megabyte for each.
MOST_LANGUAGES = 512


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[128:] = 27 + np.arange(128) % (SYMBOLS - 27)
    return table


CLASSES = _classes()


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: (trigram, language): log probability of a symbol after the two before it.
    log_p: np.ndarray


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of all words, where each word's begin, and the word at which each text begins.

    Also the text of each trigram's word.
    """
    data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    cls = CLASSES[np.frombuffer(b"  " + b"   ".join(data) + b"   ", np.uint8)]
    letter = cls > 0
    inside = letter[2:] | letter[1:-1]
    trigrams = (cls[:-2] * SYMBOLS**2 + cls[1:-1] * SYMBOLS + cls[2:])[inside]
    begins = (letter[2:] & ~letter[1:-1])[inside]
    word_at = np.flatnonzero(begins)
    ends = np.cumsum([len(d) + 3 for d in data]) if data else np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    text_of = np.searchsorted(ends, at, side="right")
    return trigrams, word_at, np.searchsorted(text_of[word_at], np.arange(len(data) + 1)), text_of


def _portions(columns: list[list], size) -> Iterator[slice]:
    first, total = 0, 0
    for i, x in enumerate(columns):
        if total and total + size(x) > BATCH_BYTES:
            yield slice(first, i)
            first, total = i, 0
        total += size(x)
    if first < len(columns):
        yield slice(first, len(columns))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learns from the rows that have a language and a text; all of them count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for part in _portions(texts, len):
                trigrams, _, _, text_of = _symbols(texts[part])
                names, code = np.unique(np.array(langs[part], object), return_inverse=True)
                grid = np.bincount(code[text_of] * TRIGRAMS + trigrams, minlength=len(names) * TRIGRAMS).reshape(-1, TRIGRAMS)
                for name, row in zip(names, grid, strict=True):
                    totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(row[seen], pa.int64())], ["lang", "trigram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would be too large to send to every task")
    counted = rows.mapInArrow(giving_back(count), "lang string, trigram bigint, n bigint").groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return LanguageModel([], np.zeros((TRIGRAMS, 0), np.float32))
    counts = np.zeros((TRIGRAMS, len(languages)))
    counts[counted["trigram"].to_numpy(np.int64), np.searchsorted(languages, counted["lang"].to_numpy(str))] = counted["n"].to_numpy()
    before = counts.reshape(-1, SYMBOLS, len(languages)).sum(axis=1)
    log_p = np.log((counts + SMOOTHING) / np.repeat(before + SMOOTHING * SYMBOLS, SYMBOLS, axis=0))
    return LanguageModel(languages, log_p.astype(np.float32))


def _em(likely: np.ndarray, first: np.ndarray, of: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (text, language) and log likelihood (without each word's maximum) of each text.

    ``likely``: (word, language), each word's largest is 1.  ``allowed``: (text, language) booleans.
    A text is done when a round changes none of its proportions by more than TOLERANCE.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.diff(np.append(first, len(likely)))
    left, words, starts, whose = np.arange(len(first)), likely, first, of
    for _ in range(rounds):
        before = share[left]
        part = words * before[whose]
        part /= part.sum(axis=1, keepdims=True)
        share[left] = np.add.reduceat(part, starts, axis=0) / n[left, None]
        going = np.abs(share[left] - before).max(axis=1) > TOLERANCE
        if not going.any():
            break
        if going.sum() < 0.75 * len(left):
            own = going[whose]
            words, whose, left = words[own], (np.cumsum(going) - 1)[whose[own]], left[going]
            starts = np.cumsum(n[left]) - n[left]
    return share, np.add.reduceat(np.log((likely * share[of]).sum(axis=1)), first)


def mixtures(log_word: np.ndarray, first: np.ndarray, *, penalty: float, rounds: int = ROUNDS, most: int | None = None) -> np.ndarray:
    """(text, language) proportions under each text's chosen set of languages.

    ``log_word``: (word, language) log likelihoods; ``first``: each text's first word, every text has one.
    """
    texts, langs = len(first), log_word.shape[1]
    top = log_word.max(axis=1, keepdims=True)
    likely = np.exp(np.maximum(log_word - top, -60.0))
    n = np.diff(np.append(first, len(log_word)))
    alone = np.add.reduceat(np.maximum(log_word - top, -60.0), first, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.zeros((texts, langs))
    chosen[np.arange(texts), best] = 1.0
    value = alone[np.arange(texts), best]
    cost = penalty * np.log(n + 1.0)
    # no mixture gains more than -value, since every word's largest likelihood is 1
    left = np.flatnonzero(-value > cost)
    if langs < 2 or not len(left):
        return chosen

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(which)), n[which])
        starts = np.cumsum(n[which]) - n[which]
        return likely[np.arange(len(of)) - starts[of] + first[which][of]], starts, of

    words, starts, of = part(left)
    share, _ = _em(words, starts, of, np.ones((len(left), langs)), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    score = value[left]
    for k in range(2, (langs if most is None else min(most, langs)) + 1):
        # no fit is above 0, so a text whose score the cost of k languages has reached is settled
        going = np.flatnonzero(-(k - 1) * cost[left] > score)
        if not len(going):
            break
        if len(going) < len(left):
            left, order, score = left[going], order[going], score[going]
            words, starts, of = part(left)
        allowed = np.zeros((len(left), langs))
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        share, fit = _em(words, starts, of, allowed, rounds)
        better = fit - (k - 1) * cost[left] > score
        score = np.where(better, fit - (k - 1) * cost[left], score)
        chosen[left[better]] = share[better]
    return chosen


def identify(docs: DataFrame, model: LanguageModel, *, keep: list[str], text: str = "text", penalty: float = 3.0, rounds: int = ROUNDS, most: int | None = None) -> DataFrame:
    """The columns in ``keep`` and __lang, __score (its proportion) and __mixture of every row.

    ``und`` with score 0 stands for a null text, a text without letters, or a
    model without languages.  Equal proportions go to the language that sorts first.  Repeated rows, empty tables and
    other columns need no care; a very long text is worked on alone, whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    names = ["kept", "__lang", "__score", "__mixture"]
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, __lang string, __score double, __mixture array<struct<lang: string, share: double>>"

    def predict(texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        languages, log_p = shared.value.languages, shared.value.log_p
        lang, score, mixed = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        trigrams, word_at, word_of, _ = _symbols(texts)
        some = [i for i, t in enumerate(texts) if word_of[i + 1] > word_of[i] and (t.isascii() or any(map(str.isalpha, t)))] if languages else []
        if not some:
            return lang, score, mixed
        log_word = np.add.reduceat(log_p[trigrams], word_at, axis=0)
        if len(some) < len(texts):
            log_word = np.concatenate([log_word[word_of[i] : word_of[i + 1]] for i in some])
        n = np.array([word_of[i + 1] - word_of[i] for i in some])
        share = mixtures(log_word, np.cumsum(n) - n, penalty=penalty, rounds=rounds, most=most)
        for i, row in zip(some, share, strict=True):
            at = int(row.argmax())
            lang[i], score[i] = languages[at], min(1.0, float(row[at]))
            mixed[i] = [{"lang": languages[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0]
        return lang, score, mixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _portions(texts, lambda t: len(t or "")):
                lang, score, mixed = predict(texts[part])
                kept = batch.column("kept").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, kind)], names)

    return rows.mapInArrow(giving_back(run), schema).select("kept.*", *names[1:])


def held_out(key: Column) -> Column:
    return crc_fold(key, 3) == 1


def predict_languages(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture: learnt from the rows that are not held out.

    Nulls, empty and very long texts, ties, repeated rows and empty tables are as in ``identify``; a null id
    counts as the empty text in the fold.
    """
    model = learn(docs.where(~held_out(F.col(key))))
    found = identify(docs, model, keep=[key], **options)
    return found.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__mixture").alias("mixture"))


#: Share below which no language of a document is its language.
LEAST_SHARE = 0.4


def in_a_language(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text has letters and a language with LEAST_SHARE of it or more.

    All labelled rows teach; where none does, all rows with letters stay.  Null and empty texts go, repeated
    rows are judged alike; columns may have any names.
    """
    model = learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs.select(F.struct("*").alias("row"), "text"), model, keep=["row"], **options)
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SHARE)).select("row.*")
