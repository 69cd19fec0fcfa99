import random

import numpy as np
import xxhash

from tessera.llm import simhash as S


def plain_fingerprint(text, k=4):
    w = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(ids, fps, radius):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= radius:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprints(hostile):
    for r in hostile.collect():
        assert S.fingerprint(r.text or "") == plain_fingerprint(r.text or "")
    assert S.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_components_match_all_pairs(spark, small, hostile, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    want = plain_components(ids, [plain_fingerprint(texts[i]) for i in ids], S.RADIUS)
    got = S.simhash_components(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16 for r in got)
    rows = S.simhash_components(hostile).collect()
    by = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 9 and by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4
    assert S.simhash_components(nothing).collect() == []


def test_planted_distances(spark):
    rng = random.Random(3)
    fps, ids = [], []
    for base in range(60):
        x = rng.getrandbits(64)
        for copy in range(5):
            bits = rng.sample(range(64), rng.choice([0, 2, 3, 4, 5]))
            fps.append(x ^ sum(1 << b for b in bits))
            ids.append(base * 5 + copy)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    fp_of = dict(zip(signed, ids))
    got = {r.fp: r.component for r in S.fingerprint_components(table).collect()}
    want = plain_components(ids, fps, 4)
    assert {k: want[v] for k, v in fp_of.items()} == got


def test_block_numbers_and_heavy_rows_keep_the_result(spark):
    rng = random.Random(13)
    fps = []
    for base in range(80):
        x = rng.getrandbits(64)
        fps += [x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 3, 4, 5]))) for _ in range(6)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    want = plain_components(range(len(fps)), fps, 4)
    for number, heavy in ((6, 2), (7, S.HEAVY), (8, 2)):
        got = {r.fp: r.component for r in S.fingerprint_components(table, number=number, heavy_rows=heavy).collect()}
        assert got == {f: want[i] for i, f in enumerate(signed)}


def test_heavy_buckets_lose_no_link(spark):
    rng = random.Random(4)
    x = rng.getrandbits(64) & ~0xFFFFFF
    fps = sorted({x | rng.getrandbits(24) for _ in range(6_000)})
    signed = np.array(fps, np.uint64).view(np.int64)
    table = spark.createDataFrame([(i, int(v)) for i, v in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component for r in S.fingerprint_components(table, 2).collect()}
    parent = np.arange(len(fps))
    u = np.array(fps, np.uint64)
    while True:
        new = np.array([parent[np.bitwise_count(u ^ v) <= 2].min() for v in u])
        if np.array_equal(new, parent):
            break
        parent = new
    assert [got[int(v)] for v in signed] == parent.tolist()


def test_near_copies(spark, hostile, nothing):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(5_000)]
    rows, n = [], 0
    for group in range(40):
        text = rng.choices(words, k=300)
        for copy in range(rng.choice([1, 3, 6])):
            own = list(text)
            for _ in range(2 * copy % 6):
                own[rng.randrange(300)] = rng.choice(words)
            rows.append((n, " ".join(own), group))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, own long")
    kept = S.without_near_copies(docs).collect()
    first = {}
    for i, _, g in rows:
        first.setdefault(g, i)
    assert sorted(r.doc_id for r in kept) == sorted(first.values())
    assert sorted(r.doc_id for r in S.without_near_copies(hostile).collect()) == [1, 4, 6, 7, 8]
    assert S.without_near_copies(nothing).collect() == []


def _varied(rng, words, kind, share):
    """A text of 200 words and a copy with words added, cut off, put in or replaced."""
    text, n = rng.choices(words, k=200), int(200 * share)
    if kind == "appended":
        return text, text + rng.choices(words, k=n)
    if kind == "cut":
        return text, text[: 200 - n]
    if kind == "inserted":
        return text, text[:90] + rng.choices(words, k=n) + text[90:]
    own = list(text)
    for i in rng.sample(range(200), max(1, n // 6)):
        own[i] = rng.choice(words)
    return text, own


def _grams(text):
    return {tuple(text[i : i + 5]) for i in range(len(text) - 4)}


def test_near_copies_by_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(20_000)]
    texts = [x for i in range(600) for x in _varied(rng, words, ("appended", "cut", "inserted", "replaced")[i % 4], rng.uniform(0.1, 0.28))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in S.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i in range(0, len(texts), 2):
        a, b = _grams(texts[i]), _grams(texts[i + 1])
        want |= {i} if 5 * len(a & b) >= 4 * len(a | b) else {i, i + 1}
    assert 600 < len(want) < 1_100
    assert kept == want


def test_near_copies_count_distinct_shingles(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5_000)]
    line = rng.choices(words, k=8)
    far = [rng.choices(words, k=40) + line * 60 for _ in range(2)]  # few shingles in common, but these many times
    body = rng.choices(words, k=200)
    less = [body, body + rng.choices(words, k=70)]  # a similarity of 0.74
    rows = [(i, " ".join(t)) for i, t in enumerate([*far, *less])]
    assert sorted(r.doc_id for r in S.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 1, 2, 3]


def test_near_copies_of_a_scattered_family(spark):
    """Copies of a text with more or fewer changes: few are near the first, many near some other; blocks of all sizes."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(20_000)]
    body = rng.choices(words, k=150)
    texts = []
    for _ in range(300):
        own = list(body)
        for i in rng.sample(range(150), rng.randint(0, 9)):
            own[i] = rng.choice(words)
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    grams = [_grams(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(grams):
        for j in range(i):
            both = len(a & grams[j])
            if 5 * both >= 4 * (len(a) + len(grams[j]) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    want = {find(i) for i in range(len(texts))}
    assert 20 < len(want) < 280
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (S.PART_ROWS, 20):
        assert {r.doc_id for r in S.without_near_copies(table, block).collect()} == want


def test_near_copies_of_a_large_family(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(20_000)]
    body = rng.choices(words, k=200)
    texts = [body + rng.choices(words, k=8) for _ in range(4_500)]
    far = [body + rng.choices(words, k=60) for _ in range(20)]  # less similar than 0.8 to all but their own copies
    texts += [t + extra for t in far for extra in ([], rng.choices(words, k=20))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in S.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, *range(4_500, 4_540, 2)}
