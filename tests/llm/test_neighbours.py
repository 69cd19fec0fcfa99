"""Cross-polytope search against brute force: planted neighbours, no structure, copies, sizes and hostile rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, nearest=10):
    """The nearest rows of each query by position, so that repeated rows stay apart."""
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for k, (i, v) in enumerate(sound):
        if i % every == 0:
            far = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for n, (j, w) in enumerate(sound) if n != k and len(w) == len(v))
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(far[:nearest])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def same(got, want):
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [w[:3] for w in want]
    assert np.allclose([r.score for r in got], [w[3] for w in want], rtol=1e-12)


def found(df):
    return sorted(df.collect(), key=lambda r: (r.query_id, r["rank"]))


def test_hadamard():
    x = np.random.default_rng(1).standard_normal((3, 32))
    whole = np.array([[(-1) ** bin(i & j).count("1") for j in range(32)] for i in range(32)]) / np.sqrt(32)
    assert np.allclose(N.hadamard(x), x @ whole)
    assert np.allclose(N.hadamard(N.hadamard(x)), x)


def test_gaps_of_prefixes_bound_those_of_buckets():
    h = N.CrossPolytope(20, 9)
    x = np.random.default_rng(2).standard_normal((7, 20))
    gaps = h.gaps(x, 1)
    each = h.bucket_gaps(gaps, np.arange(1 << 9))
    assert (each.argmin(1) == h.buckets(x, 1)).all()
    for bits in (0, 3, 6, 7, 9):
        assert np.allclose(h.prefix_gaps(gaps, bits), each.reshape(7, 1 << bits, -1).min(2))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3_000, 16)) * rng.lognormal(0, 0.5, (3_000, 1))
    x[1_000:2_000] = x[0] + 0.05 * rng.standard_normal((1_000, 16))  # a dense third
    x[2_000:2_400] = x[100]  # copies, also of a query
    rows = list(enumerate(x.astype(np.float32).tolist()))
    same(found(N.nearest_neighbours(table(spark, rows))), brute(rows))


def test_few_buckets_find_near_ones(spark):
    """Clusters: the radius shrinks with the distance found, so few members are looked at, and recall stays over 0.99."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((150, 64))
    x = np.repeat(centre, 40, axis=0) + 0.25 * rng.standard_normal((6_000, 64))
    rows = list(enumerate(x.astype(np.float32).tolist()))
    got, want = found(N.nearest_neighbours(table(spark, rows))), brute(rows)
    hits = {(r.query_id, r.vec_id) for r in got} & {w[:1] + w[2:3] for w in want}
    assert len(hits) >= 0.99 * len(want)
    h = N.CrossPolytope(64, 6)
    gap = h.bucket_gaps(h.gaps(x[::100] / np.linalg.norm(x[::100], axis=1, keepdims=True), 0), np.arange(64))
    radius = N.radius_at(h.radii(N.MISS ** (1 / N.TABLES))[0], np.array([0.85]))[0]
    assert (gap <= radius).mean() < 0.15


def test_miss_is_as_stated():
    h = N.CrossPolytope(64, 8)
    rng = np.random.default_rng(5)
    q = rng.standard_normal((20_000, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    u = rng.standard_normal(q.shape)
    u -= (u * q).sum(1, keepdims=True) * q
    x = 0.45 * q + np.sqrt(1 - 0.45**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    radius = N.radius_at(h.radii(0.05 ** (1 / 4))[0], np.array([0.45]))[0]
    missed = np.ones(len(q), bool)
    for t in range(4):
        bucket, gaps = h.buckets(x, t), h.gaps(q, t)
        own = gaps[0][np.arange(len(q)), bucket >> 1] + gaps[1][np.arange(len(q)), bucket & 1]
        missed &= own > radius
    assert 0.03 < missed.mean() < 0.07


def test_hostile_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (0, v), (100, [0.0, 0.0, 0.0]), (200, None), (300, []), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0]), (None, v), (-100, [1e30, 1e30, -1e30]), (7, [1e-30, 0.0, 1e-30]), (8, v), (700, [1.0, 2.0]), (9, [2.0, 2.0, 3.0]), (11, [1.0, 3.0, 3.0])]
    want = brute(rows)
    df = table(spark, rows).withColumns({n: F.lit(1) for n in ("rep", "vec", "query", "query_id", "bucket", "grp", "a.b", "score", "ids")})
    got = found(N.nearest_neighbours(df))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    assert {r.query_id for r in got} == {0, -100}
    assert [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0][:4] == [(1, 0, 0.0), (1, 0, 0.0), (2, 8, 0.0), (2, 8, 0.0)]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [2.0, 1.0])]])
def test_nothing_to_find(spark, rows):
    got = N.nearest_neighbours(table(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.collect() == []
