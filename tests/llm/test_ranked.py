"""Ranked search against plain sums, on both ways of joining, and on hostile rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import ranked as R

DOCS, ITEMS = "doc_id long, text string, n long, tf int", "item_id long, text string"


def words(text):
    out, own = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [own] if own else []
            own = ""
        else:
            own += c.lower() if c.isascii() else c
    return out


def brute(docs, items, best=20):
    have = [(i, words(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in have), sum(len(w) for _, w in have)
    df = Counter(t for _, w in have for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for k, (i, w) in enumerate(have):
            tf, m = Counter(w), 75 + 25 * len(w) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if tf[t])
            if s:
                scores.append((-s, i is not None, i or 0, k, i))
        out += [(item, r + 1, i, -s) for r, (s, *_, i) in enumerate(sorted(scores)[:best])]
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def check(spark, docs, items, **how):
    got = R.ranked(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS), spark.createDataFrame(items, ITEMS), **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


@pytest.mark.parametrize("how", [{}, {"vocabulary": 3}, {"broadcast_rows": 2}])
def test_against_plain_sums(spark, how):
    docs = [(i, " ".join(f"w{(i * k) % (7 + k)}" for k in range(1, 2 + i % 40)) + (" Common,word" if i % 3 else "")) for i in range(300)]
    items = [(1, "common word W3 w3-w5 zz"), (2, "w1"), (2, "w0 w1"), (3, "unknown"), (None, "WORD"), (4, None), (5, ""), (6, " ,;")]
    check(spark, docs, items, **how)


def test_hostile_rows(spark):
    long = "naïve İstanbul 漢字-kanji " * 30_000
    docs = [(None, "alpha beta"), (None, "alpha beta"), (1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "\x00alpha\x7fBETA_gamma"), (5, long), (6, "straße STRASSE   alpha"), (7, "delta")]
    items = [(10, "Alpha"), (11, "kanji 漢字 İstanbul istanbul"), (12, "gamma straße"), (13, "delta beta delta")]
    check(spark, docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", 1, 2)], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert R.ranked(docs.limit(0), items).collect() == [] and R.ranked(docs, items.limit(0)).collect() == []
    assert R.ranked(docs.where(F.lit(False)), items.limit(0)).collect() == []
