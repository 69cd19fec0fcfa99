"""Licence scans by a positional index of rare words.

Templates (whole licence texts, short notices and the base phrases) are word sequences. A word's weight is its
inverse document frequency over the templates. The index has postings (template, place) of each template's RARE
heaviest words among its mandatory phrases. Of a file, the posted words are looked up, heaviest first; each gives the
starts at which a template would have it in place, the starts that all of a template's posted words agree on are
intersected, and there its mandatory key phrases must stand at their places. So a template is found exactly where its
mandatory phrases are in place. A base phrase is all mandatory: every place where its words stand consecutively counts.

A text's words are runs of ASCII letters and digits (lower-cased) and of non-ASCII characters. Null texts count
as empty and give no label, null places and score 0. Very long texts are scanned whole. Equal texts get equal rows, an
empty table gives an empty one, and only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, text_or_empty
from tessera.llm.licence_texts import BASE, NOTICES, TEXTS

RARE = 4
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


class Index:
    """Postings of each template's rare words, and its mandatory places."""

    def __init__(self, notices: dict[str, tuple[str, tuple[str, ...]]] | None = None, base: dict[str, str] = BASE, rare: int = RARE):
        notices = NOTICES | TEXTS if notices is None else notices
        self.templates = [(label, words_of(text), phrases, False) for label, (text, phrases) in notices.items()]
        self.templates += [(label, words_of(text), (text,), True) for text, label in base.items()]
        df = Counter(w for _, words, _, _ in self.templates for w in set(words))
        self.idf = {w: math.log(1 + len(self.templates) / n) for w, n in df.items()}
        self.weight = [sum(self.idf[w] for w in words) for _, words, _, _ in self.templates]
        self.must: list[list[tuple[int, bytes]]] = []
        self.posted: list[int] = []
        postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, phrases, _) in enumerate(self.templates):
            places: dict[int, bytes] = {}
            for phrase in map(words_of, phrases):
                first = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
                places |= {first + i: w for i, w in enumerate(phrase)}
            heavy = sorted(places, key=lambda i: (-self.idf[places[i]], i))[:rare]
            self.must.append(sorted(places.items()))
            self.posted.append(len(heavy))
            for i in heavy:
                postings[places[i]].append((t, i))
        self.postings = dict(postings)

    def candidates(self, words: list[bytes]) -> dict[int, np.ndarray]:
        """Template to the starts that all its posted words agree on."""
        here = self.postings.keys() & set(words)
        if not here:
            return {}
        places: dict[bytes, list[int]] = {w: [] for w in here}
        for i, w in enumerate(words):
            if w in here:
                places[w].append(i)
        starts: dict[int, np.ndarray] = {}
        met: Counter = Counter()
        for w in sorted(here, key=lambda w: (-self.idf[w], w)):
            at = np.array(places[w])
            for t, place in self.postings[w]:
                starts[t] = at - place if t not in starts else np.intersect1d(starts[t], at - place, assume_unique=True)
                met[t] += 1
        return {t: found for t, found in starts.items() if met[t] == self.posted[t] and len(found)}

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """(starts of base phrases, base labels, all labels, score)."""
        found_at, base, labels, score = [], set(), set(), 0.0
        for t, starts in self.candidates(words).items():
            label, template, _, is_base = self.templates[t]
            for s in starts.tolist():
                if any(not 0 <= s + i < len(words) or words[s + i] != w for i, w in self.must[t]):
                    continue
                labels.add(label)
                if is_base:
                    found_at.append(s)
                    base.add(label)
                same = sum(self.idf[w] for i, w in enumerate(template) if 0 <= s + i < len(words) and words[s + i] == w)
                score = max(score, same / self.weight[t])
        return found_at, base, labels, min(1.0, score)


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row a document; see the module's text and the columns' names."""
    arrow_limits(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                starts, base, labels, score = index.scan(words)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(work, schema)
