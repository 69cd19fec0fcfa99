import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix as X


def plain(rows):
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for i, b in sorted(rows):
        gone = bytearray(len(b))
        for s in range(len(b) - X.WINDOW + 1):
            w = b[s : s + X.WINDOW]
            if w in seen:
                gone[s : s + X.WINDOW] = b"\1" * X.WINDOW
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest())
    return out


def digest(table, **kw):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in X.suffix_digest(table, **kw).collect()}


@pytest.mark.parametrize(("heavy", "local"), [(X.HEAVY, X.LOCAL), (1, X.LOCAL), (3, 2), (X.HEAVY, 1)])
def test_documents(spark, small, heavy, local):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert digest(docs, heavy=heavy, local=local) == plain([(r.doc_id, r.text.encode()) for r in docs.collect()])


@pytest.mark.parametrize(("heavy", "local"), [(X.HEAVY, X.LOCAL), (2, 1)])
def test_passages_and_periods(spark, heavy, local):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcé ", k=rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        a = rng.randrange(len(passage) - 20)
        inner = passage[a : a + rng.randrange(20, 400)]
        own = " ".join(word() for _ in range(rng.randint(0, 60)))
        rows.append((i * 3 - 20, rng.choice([own + inner, inner + own, own + inner + own, "ab" * rng.randint(1, 200), "a" * rng.randint(90, 400), inner])))
    rows += [(1000, "x" * 99), (1001, "y" * 100), (1002, "y" * 100), (1003, "y" * 101), (1004, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(table, heavy=heavy, local=local) == plain([(i, t.encode()) for i, t in rows])


def test_long_documents_come_in_slices(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(4_000)]
    long = " ".join(rng.choices(words, k=110_000)).encode()
    assert len(long) > 2 * X.SLICE
    around = long[X.SLICE - 300 : X.SLICE + 300]
    rows = [(1, long), (2, b"x" + long), (3, around), (4, long[X.SLICE // 2 :] + b"y" * 300)]
    table = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    assert digest(table) == plain(rows) == digest(table, heavy=1, local=1)


def test_second_names_tell_thue_morse_words_apart():
    bits = [0]
    while len(bits) < 128:
        bits += [1 - b for b in bits]
    word = np.array([97 + b for b in bits] + [98 - b for b in bits], np.uint8)
    start = np.array([0, 128])
    names = X.Names(word)
    assert len(set(names.second(start, start + 128).tolist())) == 2
    again = X.Names(np.concatenate([word, word]))
    assert np.array_equal(again.second(start + 256, start + 384), names.second(start, start + 128))


def test_hostile(hostile, nothing):
    want = plain({(r.doc_id, (r.text or "").encode()) for r in hostile.collect()})
    rows = X.suffix_digest(hostile).collect()
    assert len(rows) == 9 and all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert X.suffix_digest(nothing).collect() == []
    assert X.remove_repeats(nothing).collect() == []
    clash = hostile.withColumnsRenamed({"low": "range_low", "high": "range_high"})
    kept = X.remove_repeats(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8]


def test_removed_text_is_whole_characters(spark):
    a, b = "é" * 20 + "".join(chr(0x4E00 + i) for i in range(80)), "ü" + "".join(chr(0x4E00 + i) for i in range(80)) + "ß"
    table = spark.createDataFrame([(1, a, 100, "s"), (2, b, 82, "s"), (3, None, None, "s"), (4, a, 100, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: (r.text, r.n_chars) for r in X.remove_repeats(table).collect()}
    assert got == {1: (a, 100), 2: ("üß", 2), 3: (None, None)}


def test_one_id_with_different_texts(spark):
    """Places are told apart by text, so passages that they share with each other and with other documents go once."""
    rng = random.Random(9)
    passage = ["".join(rng.choices("abcdefg ", k=260)) for _ in range(3)]
    rows = [(1, passage[0] + "one"), (2, "x" + passage[0] + passage[1]), (2, passage[1] + "y" * 40), (2, None), (3, passage[2] + passage[1]), (3, "short"), (3, passage[2]), (3, passage[2]), (None, passage[0])]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    hashes = {(r.doc_id, r.text): r.h for r in table.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()}
    distinct = sorted({(i, hashes[i, t], (t or "").encode()) for i, t in rows if i is not None})
    want = plain([((i, h), b) for i, h, b in distinct])
    got = X.suffix_digest(table).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == {(i, *v) for (i, _), v in want.items()}
    kept = X.remove_repeats(table).collect()
    assert all(r.n_chars == len(r.text or "") for r in kept) and passage[0] in {r.text for r in kept if r.doc_id is None}
    assert sum((r.text or "").count(passage[1][100:-100]) for r in kept if r.doc_id is not None) == 1
