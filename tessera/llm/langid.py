"""Language identification by word-first backoff.

The model holds, by language, the log frequency of words and of character n-grams of 5 letters down to 1, from a
bounded sample of labelled documents: TRAIN_DOCS of them, by the smallest hash of doc_id, whole texts; all its counts
are kept. A word is a run of Unicode letters with the combining marks among them. A known word scores by its own frequencies. An unseen word falls back to the
longest n-grams of it (with its ends marked) that are known, scored by their mean. Every word of every text
counts; a text's language is the one of the largest sum (ties: the first by name), its score that language's
part of the softmax of the sums, tempered by the square root of the number of words.

Null texts and texts without a letter are `und` with score 0; so is all when no labelled row can be learned
from. Very long texts count whole. lang, source and doc_id aren't inputs of a prediction. An empty table gives an empty result, and only
doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, forget, mix, plain_names, schema_of, stored

TRAIN_DOCS, ORDERS, CACHE = 3_000, (5, 4, 3, 2, 1), 300_000
#: Letters (and marks after them) by category; of texts of Latin letters and common punctuation by a faster pattern.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LATIN, LATIN_LETTERS = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*"), re.compile(r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")
UNKNOWN = "und"
#: An odd multiplier for the hashes of n-grams.
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text."""
    low = text.lower()
    return LATIN_LETTERS.findall(low) if LATIN.fullmatch(low) else LETTERS.findall(low)


def held_out() -> Column:
    """Documents that training never sees: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def grams_of(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts of words (order 0) and n-grams, once for each task's batch."""
    for b in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
        rows: Counter = Counter()
        for lang, own in words.items():
            for word, k in own.items():
                rows[lang, 0, word] += k
                for n in ORDERS:
                    for g in grams_of(word, n):
                        rows[lang, n, g] += k
        if rows:
            lang, order, gram = zip(*rows)
            yield pa.record_batch([pa.array(lang), pa.array(order, pa.int32()), pa.array(gram), pa.array(list(rows.values()), pa.int64())], names=["lang", "n", "gram", "k"])


def _ends(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their ends marked, the word of each, and how many its word has from there on."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    return points, word, np.cumsum(sizes)[word] - np.arange(len(points))


def _gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """At n - 1: a hash of the n code points from each place on."""
    out = [mix(points + STEP)]
    for n in range(1, max(ORDERS)):
        out.append(mix(out[-1][:-1] * STEP + points[n:]))
    return out


def count_rows(rows: list[tuple[str, int, str, int]]) -> pa.Table:
    """(lang, n, gram, k) as a table."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(("lang", "n", "gram", "k"), kinds))})


class Model:
    """Log frequencies by order: words by name, n-grams by sorted hashes, each with a row over the sorted languages."""

    def __init__(self, rows: pa.Table, totals: list[tuple[str, int, int]]):
        """rows: (lang, n, gram, k), totals: (lang, n, sum of k)."""
        self.langs = sorted({lang for lang, _, _ in totals})
        place = {x: i for i, x in enumerate(self.langs)}
        size = np.zeros((max(ORDERS) + 1, max(1, len(self.langs))))
        for lang, n, k in totals:
            size[n, place[lang]] = k
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        lang = np.array([place[x] for x in lang.dictionary.to_pylist()] or [0])[lang.indices.to_numpy()]
        order, k = rows.column("n").to_numpy(), rows.column("k").to_numpy()
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in (0, *ORDERS):
            own = np.flatnonzero(order == n)
            grams = rows.column("gram").take(pa.array(own)).combine_chunks().dictionary_encode()
            counts = np.zeros((len(grams.dictionary), size.shape[1]))
            counts[grams.indices.to_numpy(), lang[own]] = k[own]
            logs = np.log((counts + 0.5) / (size[n] + 0.5 * (len(counts) + 1)))
            names = grams.dictionary.to_pylist()
            if n == 0:
                self.words, self.word_logs = {w: i for i, w in enumerate(names)}, logs
                continue
            points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            keys = _gram_hashes(points)[n - 1][::n] if len(points) else np.zeros(0, np.uint64)
            by_key = np.argsort(keys)
            self.grams[n] = keys[by_key], logs[by_key]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row over the languages for each lower-cased word."""
        out = np.zeros((len(words), max(1, len(self.langs))))
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[known >= 0] = self.word_logs[known[known >= 0]]
        unseen = np.flatnonzero(known < 0)
        if not len(unseen) or not self.langs:
            return out
        points, word, left = _ends([words[i] for i in unseen])
        hashes, open_words = _gram_hashes(points), np.ones(len(unseen), bool)
        for n in ORDERS:  # the longest first; a word with a known n-gram is done
            keys, logs = self.grams[n]
            at = np.flatnonzero(open_words[word] & (left >= n))
            if not len(keys) or not len(at):
                continue
            h = hashes[n - 1][at]
            row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[row] == h
            own, row = word[at[hit]], row[hit]
            times = np.bincount(own, minlength=len(unseen))
            got = times > 0
            for lang in range(len(self.langs)):
                total = np.bincount(own, weights=logs[row, lang], minlength=len(unseen))
                out[unseen[got], lang] = total[got] / times[got]
            open_words &= ~got
        return out


class Predictor:
    """Scores batches of texts; keeps up to CACHE words' scores, then starts anew."""

    def __init__(self, model: Model):
        self.model, self.width = model, max(1, len(model.langs))
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, self.width))

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.row.keys())
        if len(self.row) + len(new) > CACHE:
            self.row, self.table, new = {}, np.zeros((0, self.width)), list(words)
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        self.table = np.concatenate([self.table, self.model.scores(new)])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        words = [words_of(t) if t else [] for t in texts]
        self._learn(set().union(*words))
        out = []
        for own in words:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.table[np.fromiter(map(self.row.__getitem__, own), np.int64, len(own))].sum(0)
            best = int(np.argmax(total))
            out.append((self.model.langs[best], float(1 / np.exp((total - total[best]) / np.sqrt(len(own))).sum())))
        return out


def train(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, lang); only its bounded counts reach the driver."""
    arrow_limits(labelled.sparkSession)
    usable = labelled.where("text is not null and lang is not null").select(F.struct(F.xxhash64("doc_id"), F.xxhash64("text")).alias("by"), "lang", "text")
    bound = usable.select("by").distinct().orderBy("by").limit(TRAIN_DOCS).agg(F.max("by").alias("most"))
    # equal rows count once, so at most TRAIN_DOCS are learned from, also of rows that share an id or have none
    sample = usable.join(F.broadcast(bound), F.col("by") <= F.col("most")).groupBy("by").agg(F.min("lang").alias("lang"), F.min("text").alias("text")).select("lang", "text")  # one row
    if sample.isEmpty():
        return Model(count_rows([]), [])
    counts = sample.mapInArrow(_counted, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    counts = stored(counts, "language_counts")
    totals = [tuple(r) for r in counts.groupBy("lang", "n").agg(F.sum("k").alias("k")).collect()]
    rows = counts.select("lang", "n", "gram", "k").toArrow()  # of the bounded sample
    forget(counts)
    return Model(rows, totals)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """The table with lang_pred and score, in place of its own columns of these names."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    names, docs = [c for c in docs.columns if c not in ("lang_pred", "score")], docs.drop("lang_pred", "score")
    docs = plain_names(docs, "text")
    others = [c for c in docs.columns if c != "text"]
    schema = f"{schema_of(docs, ['text', *others])}, lang_pred string, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            got = [x for at in range(0, len(texts), 500) for x in predictor.predict(texts[at : at + 500])]
            lang, score = zip(*got) if got else ((), ())
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    out = docs.select("text", *others).mapInArrow(work, schema)
    return out.select(*docs.columns, "lang_pred", "score").toDF(*names, "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, with their own columns, whose language is found with at least this score."""
    plain = plain_names(docs, "text")
    found = predicted(plain, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*plain.columns).toDF(*docs.columns)


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that aren't held out."""
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = predicted(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
