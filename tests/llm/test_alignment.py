"""Alignment against plain loops over the two public libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import alignment as A
from tessera.llm.bpe import byte_letters
from tessera.llm.queries import vocabulary

A_PATH, B_PATH = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def tokens(libraries, text):
    """(ids, bytes) of both."""
    a, b = libraries
    back = {c: n for n, c in enumerate(byte_letters())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    names_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    names_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return (ids_a, names_a), (ids_b, names_b)


def spans(names):
    at, out = 0, []
    for x in names:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute(libraries, texts):
    links, rows = [], []
    for t in texts:
        (ids_a, names_a), (ids_b, names_b) = tokens(libraries, t or "")
        data = (" " + (t or "")).encode()
        if not t or b"".join(names_a) != data or b"".join(names_b) != data:
            links.append([])
            rows.append(None)
            continue
        sa, sb = spans(names_a), spans(names_b)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        first = 0
        own, text = [], []
        for (s, e), i in zip(sa, ids_a):
            while sb[first][1] <= s:
                first += 1
            k = first
            while k < len(sb) and sb[k][0] < e:
                own.append((i, ids_b[k]))
                k += 1
        ends_a, ends_b, at = iter(zip(sa, ids_a)), iter(zip(sb, ids_b)), None
        for c in cuts:
            part = []
            for ends in (ends_a, ends_b):
                side = []
                while not side or at != c:
                    (_, at), i = next(ends)
                    side.append(str(i))
                part.append(",".join(side))
            text.append("|".join(part))
        links.append(own)
        rows.append((len(ids_a), len(ids_b), len(cuts), hashlib.sha256(";".join(text).encode()).hexdigest()))
    counts = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [ZERO if r is None else (r[0], r[1], r[2], len(own), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), r[3]) for r, own in zip(rows, links)]


def texts_of(seed, n):
    rng = random.Random(seed)
    bits = ["the ", "tokenizer", "  ", "\n\n", "naïve", " İstanbul", "漢字かな", "🙂👩‍👩‍👧", "<|endoftext|>", "<s>", "</s>", "<0x41>", "don't", "12345", "\t", "x" * 70, "Straße ", "ا ل", " ", "é", "é", "\r\n", " ", "−", "end."]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def check(spark, libraries, texts, **how):
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, pair int")
    got = {r.doc_id: tuple(r)[1:] for r in A.alignment_digest(df, A_PATH, B_PATH, **how).collect()}
    assert [got[i] for i in range(len(texts))] == brute(libraries, texts)


@pytest.mark.parametrize("how", [{}, {"broadcast_rows": 10}])
def test_against_plain_loops(spark, libraries, how):
    check(spark, libraries, texts_of(1, 150) + ["the the the"] * 40, **how)


def test_hostile_texts(spark, libraries):
    long = " ".join(f"word{i % 977} wörd{i % 31}" for i in range(60_000))
    check(spark, libraries, [None, "", " ", "   ", "\n", "a▁b", "▁", "\x00", "a\x00b", long, "y" * 50_000, "same", "same", "�", " ", " private"])


def test_pair_table(spark, libraries):
    texts = texts_of(2, 30)
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = {(r.a_id, r.b_id): (r.docs, r.best) for r in A.pair_table(df, A_PATH, B_PATH).collect()}
    assert got and all(n >= 1 for n, _ in got.values())
    digest = A.alignment_digest(df, A_PATH, B_PATH).collect()
    assert sorted(r.count_sum for r in digest) == sorted(r[5] for r in brute(libraries, texts))
    for a in {a for a, _ in got}:
        most = max(n for (x, _), (n, _) in got.items() if x == a)
        assert all(best == (n == most) for (x, _), (n, best) in got.items() if x == a)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment_digest(df, A_PATH, B_PATH).collect() == []
