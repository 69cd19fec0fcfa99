"""Chat formatting, packing, vectors, components, pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import chat, packing, vectors
from tessera.llm.common import components
from tessera.llm.queries import QUERIES, vocabulary


def test_chat_matches_sql(spark, small):
    db = duckdb.connect()
    conversations = ds.dataset(f"{small}/conversations.parquet").to_table()
    db.register("conversations", conversations)
    want = db.execute(chat.CHAT_SQL).fetchall()
    got = QUERIES["op5_chat"](spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_chat_texts_come_back(spark):
    rng = random.Random(1)
    bits = ["<|im_start|>", "<|im_end|>", "<|", "\\", "\n", "a", "é🙂", "|>", "$1", "\\n", ""]
    text = lambda: rng.choice([None, *("".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(9))])
    rows = [(c if c else None, t, rng.choice(["user", "assistant", "system", None, "a\nb", "\\"]), text(), 1) for c in range(40) for t in range(rng.randint(1, 6))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")
    done = chat.formatted(chat.canonical_turns(chat.records_from_rows(table)))
    for r in done.withColumns({"back": chat.parsed(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect():
        own = sorted([(t, role or "", x or "") for c, t, role, x, _ in rows if c == r.conv_id])
        assert [tuple(t) for t in r.back] == [x[1:] for x in own]
        assert r.loss == "".join(x for _, role, x in own if role == "assistant")
    empty = chat.chat_digest(spark, table.limit(0)).collect()
    assert [r.conv_id for r in empty] == [-1]


def test_layouts_by_fingerprint(spark):
    rows = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "q", "output": "a"}',
        '{"instruction": "q", "input": "i", "output": "a"}',
        '{"prompt": "q", "completion": "a"}',
        '{"system": "s", "prompt": "q", "response": "a"}',
        '{"question": "q", "answer": "a", "conversations": null}',
        '{"other": 1}',
        "not json",
        None,
    ]
    table = chat.canonical_turns(chat.records_from_json(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, json string")))
    got = {r.id: r.turns and [tuple(t) for t in r.turns] for r in table.collect()}
    plain = [("user", "q"), ("assistant", "a")]
    assert [got[i] for i in (0, 1, 2, 4, 6)] == [plain] * 5
    assert got[3] == [("user", "q\n\ni"), ("assistant", "a")] and got[5] == [("system", "s"), *plain]
    assert got[7] is got[8] is got[9] is None
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check_packed(rows, texts, window=packing.WINDOW):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert docs.keys() == texts.keys()
    for d, pieces in docs.items():
        ids, at = [*library.encode(texts[d], add_special_tokens=False).ids, packing.END_ID], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(ids)
    sizes = []
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        sizes.append(at)
    assert max(sizes) <= window
    return sizes


def test_packing(spark, small, hostile, nothing):
    path = vocabulary("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = check_packed(packing.packed(docs, path).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert sum(s < packing.WINDOW for s in sizes) <= 4  # one a task
    check_packed(packing.packed(docs, path, 512, 20_000).collect(), {r.doc_id: r.text for r in docs.collect()}, 512)
    one = hostile.dropDuplicates(["doc_id"])
    check_packed(packing.packed(one, path, 64).collect(), {r.doc_id: r.text or "" for r in one.collect()}, 64)
    assert len({(r.sequence_id, r.offset) for r in packing.packed(hostile, path).collect()}) >= 9
    assert packing.packed(nothing, path).collect() == []
    assert [packing.padded_length(n) for n in (1, 3, 64, 2047, 2048)] == [1, 2048, 64, 2048, 2048]


def test_retrieval_prefers_like_documents():
    docs = [np.array(x, np.uint16) for x in ([10, 11, 12, 1], [20, 21, 1], [10, 11, 13, 1], [20, 22, 1])]
    idf = np.ones(100, np.float32)
    idf[1] = 0
    assert [p[0] for p in packing.pack_shard(docs, idf, 4, 8)] == [0, 2, 1, 3]


def test_neighbours_are_those_of_plain_bm25():
    rng = random.Random(6)
    docs = [np.array(rng.choices(range(5, 60), k=rng.randint(1, 80)) + [1], np.uint16) for _ in range(60)]
    n, mean = len(docs), sum(map(len, docs)) / 60
    idf = {t: np.log1p((n - k + 0.5) / (k + 0.5)) for t in range(100) if (k := sum(t in d for d in docs)) or True}
    index = packing.Shard(docs, np.array([idf[t] for t in range(100)], np.float32), mean)
    unused = np.array([rng.random() < 0.7 for _ in docs])
    for seed in range(n):
        want = {}
        for d in range(n):
            own = docs[d].tolist()
            score = 0.0
            for t in set(docs[seed].tolist()) & set(own):
                tf = own.count(t)
                score += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
            if score > 0 and unused[d]:
                want[d] = score
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_encoder_like_the_library():
    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(3)
    letters = [*"aAéßΣ'’ \n\t\x0b\x1c\x85\xa0漢🙂01²½#_-", "<|endoftext|>", "'s", "the ", "   "]
    for _ in range(2_000):
        t = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        assert own.ids(t) == library.encode(t, add_special_tokens=False).ids


def plain_links(table):
    """vec_id to (links, component) by all pairs."""
    sound = {}
    for n, (i, v) in enumerate(table):
        x = np.array([np.nan if c is None else c for c in v] if v else [], np.float64)
        sound[n] = x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None
    links, parent = defaultdict(int), {i: i for i, _ in table}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sound:
        for b in sound:
            if a != b and sound[a] is not None and sound[b] is not None and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= 0.9:
                links[a] += 1
                p, q = find(table[a][0]), find(table[b][0])
                parent[max(p, q)] = min(p, q)
    return sorted((i, links[n], find(i)) for n, (i, _) in enumerate(table))


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for base in rng.normal(size=(40, 16)):
        for noise in rng.choice([0, 0.02, 0.1, 0.25], 8):
            rows.append((len(rows), (base + noise * rng.normal(size=16)).astype(np.float32).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None] * 16), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (0, rows[0][1]), (908, rows[0][1])]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, rep int, links int")
    got = vectors.vector_components(table, probes=40).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.vector_components(table.limit(0)).collect() == []


def test_vector_recall(spark, small):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1_500, 64))
    near = base[:1_500] + 0.3 * rng.normal(size=(1_500, 64))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = vectors.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = int((x @ x.T >= 0.9).sum()) - len(rows)
    assert 0.9 * true <= sum(r.n_links for r in got) <= true
    whole = QUERIES["op10_quantised"](spark, small).collect()
    table = ds.dataset(f"{small}/embeddings.parquet").to_table()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in whole) == plain_links(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist())))


def test_vectors_with_a_hot_third(spark):
    rng = np.random.default_rng(3)
    n = 50_000
    hot = rng.normal(size=64) + 0.3 * rng.normal(size=(n // 3, 64))
    base = rng.normal(size=((n - len(hot)) // 2, 64))
    x = np.concatenate([hot, base, base + 0.3 * rng.normal(size=base.shape)]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}))
    got = vectors.vector_components(table).toPandas().sort_values("vec_id")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = np.concatenate([(u[at : at + 2_000] @ u.T >= 0.9).sum(1) - 1 for at in range(0, len(u), 2_000)])
    assert want.sum() > 50_000_000
    assert np.array_equal(got["n_links"].to_numpy(), want)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], small).cache())
    assert all(f.columns == docs.columns for f in frames[:-1])
    before, language, near, repeats, private, pieces = frames
    assert language.count() == before.count() and near.count() < language.count() and private.count() == repeats.count()
    digests = [hashlib.sha256(r.text.encode()).hexdigest() for r in near.collect()]
    assert len(digests) == len(set(digests))
    check_packed(pieces.collect(), {r.doc_id: r.text for r in private.collect()})
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces.collect()))
    for f in frames[1:]:
        f.unpersist()


def test_vectors_sql_links_no_zero_or_nan(spark):
    """The SQL and the operator agree on vectors that link with nothing."""
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, -1.0]), (6, [0.0, 0.0])]
    db = duckdb.connect()
    db.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows]), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    want = db.execute(vectors.VECTORS_SQL).fetchall()
    got = vectors.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[0] for r in want if r[1]} == {1, 2}
