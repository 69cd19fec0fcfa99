"""Approximate nearest neighbours by cross-polytope hashing, multiprobe tables and an exact rerank.

Hashing. A unit vector, padded to a power of two, goes through three rounds of random signs and a fast Hadamard
transform; its hash is the nearest signed axis of the result. TABLES tables have their own signs. A table's bucket
joins as many hashes as give about BUCKET_ROWS vectors a bucket; the last one may look at the first axes only.

Multiprobe. A bucket's gap for a query is the sum, over its hashes, of the squared difference between the query's
largest coordinate and its coordinate on the bucket's axis. A query asks every bucket whose gap is within its radius. How
large a radius must be depends only on the angle to a neighbour, since the rotations are random: it is measured on pairs
of random vectors at fixed cosines (nothing of the table), so that all tables together miss a neighbour at that
cosine with a chance of at most MISS. One table with the radius for cosine FIRST gives each query an upper bound on the
distance of its last result; the least cosine at which a nearer vector can lie then gives the radius for all tables.
So near neighbours cost few buckets, and vectors without any structure cost a large part of the table.

A table's buckets make groups of about GROUP members, a large one in chunks; a query is sent once to each group that
holds a bucket within its radius. Members travel as half-precision unit vectors with their length and the exact error that
this leaves, so distances have bounds; what may be among the nearest goes to the exact distance in double precision
on the original vectors. Equal vectors are one member with their smallest ids, as many as a result can hold.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without vec_id;
queries among them have no result. Only vectors of equal length are compared. Ties go to the smaller vec_id. A row that
repeats a vec_id is another row: it is a candidate for the first, and asks again if its id is a query's. An empty
table gives an empty result. Only vec_id and embedding are read, whatever the other columns' names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, numbers, stored

TABLES, BUCKET_ROWS, GROUP, PREFIX_BITS = 4, 64, 4_096, 12
MISS, FIRST = 1e-3, 0.7
#: Pairs of random vectors for each cosine at which radii are measured.
PAIRS, COSINES = 4_000, np.round(np.arange(-0.95, 1.0, 0.05), 2)
EVERY, NEAREST = 100, 10


def _matrix(n: int) -> np.ndarray:
    return np.ones((1, 1)) if n == 1 else np.kron(_matrix(n // 2), [[1, 1], [1, -1]])


RADIX = {n: _matrix(n) for n in (2, 4, 8, 16)}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, divided by the root of its length (a power of two).

    Up to four bits of the index a pass, which then become the highest ones; after the last pass all are in place.
    """
    n, width = x.shape
    rest = width
    while rest > 1:
        radix = min(16, rest)
        x = (x.reshape(-1, radix) @ RADIX[radix]).reshape(n, width // radix, radix).swapaxes(1, 2).reshape(n, width)
        rest //= radix
    return x / math.sqrt(width)


class CrossPolytope:
    """Hash tables of unit vectors of one length; bits: of a bucket's number."""

    def __init__(self, width: int, bits: int, tables: int = TABLES, seed: int = 11):
        self.width, self.bits, self.tables = width, bits, tables
        self.axes = 1 << max(0, (width - 1).bit_length())
        most = (2 * self.axes).bit_length() - 1
        self.cuts = [most] * (bits // most) + ([bits % most] if bits % most else [])
        n = tables * max(1, len(self.cuts)) * 3 * self.axes
        self.signs = np.where(numbers(n, seed) >> np.uint64(63), 1.0, -1.0).reshape(tables, -1, 3, self.axes)

    def rotated(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        """Coordinates of each vector along the signed axes that hash k looks at: the positive ones, then the negative ones."""
        y = np.zeros((len(x), self.axes))
        y[:, : self.width] = x
        for sign in self.signs[table, k]:
            y = hadamard(y * sign)
        y = y[:, : 1 << (self.cuts[k] - 1)]
        return np.concatenate([y, -y], axis=1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The number of each vector's own bucket."""
        out = np.zeros(len(x), np.int64)
        for k, bits in enumerate(self.cuts):
            out = (out << bits) | self.rotated(x, table, k).argmax(1)
        return out

    def gaps(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each hash, the squared gap of each query (row) to each signed axis."""
        sides = [self.rotated(x, table, k) for k in range(len(self.cuts))]
        return [(z.max(1, keepdims=True) - z) ** 2 for z in sides]

    def bucket_gaps(self, gaps: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
        """The gap of each query to each bucket, from gaps()."""
        out, low = np.zeros((len(gaps[0]) if gaps else 1, len(buckets))), self.bits
        for g, bits in zip(gaps, self.cuts):
            low -= bits
            out = out + g[:, (buckets >> low) & ((1 << bits) - 1)]
        return out

    def prefix_gaps(self, gaps: list[np.ndarray], bits: int) -> np.ndarray:
        """The least gap of each query to any bucket that begins with each number of so many bits."""
        out = np.zeros((len(gaps[0]) if gaps else 1, 1))
        for g, own in zip(gaps, self.cuts):
            take = min(bits, own)
            g = g.reshape(len(g), 1 << take, -1).min(2)
            out = (out[:, :, None] + g[:, None, :]).reshape(len(g), -1)
            bits -= take
        return out

    def radii(self, *misses: float) -> np.ndarray:
        """For each miss and each of COSINES, the gap within which a neighbour's bucket lies in a table, but for that chance."""
        rng = np.random.default_rng(11)
        out = []
        for c in COSINES:
            q, u = (rng.standard_normal((PAIRS, self.width)) for _ in range(2))
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            u -= (u * q).sum(1, keepdims=True) * q
            size = np.linalg.norm(u, axis=1, keepdims=True)
            x = c * q + math.sqrt(1 - c * c) * u / np.where(size > 0, size, 1)
            own = np.zeros(PAIRS)
            for table in range(self.tables):
                some = slice(table, None, self.tables)
                bucket, low = self.buckets(x[some], table), self.bits
                for g, bits in zip(self.gaps(q[some], table), self.cuts):
                    low -= bits
                    own[some] += g[np.arange(len(g)), (bucket >> low) & ((1 << bits) - 1)]
            out.append(np.quantile(own, 1 - np.array(misses), method="higher"))
        return np.maximum.accumulate(np.array(out)[::-1])[::-1].T


def radius_at(radii: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The radius for each cosine: that of the next lower one measured, and no bound below the lowest."""
    at = np.searchsorted(COSINES, cosine, side="right") - 1
    return np.where(at >= 0, radii[np.maximum(at, 0)], np.inf)


def least_cosine(size: np.ndarray, far: np.ndarray, low: float, high: float) -> np.ndarray:
    """The least cosine to a query of that size at which a vector of a size from low to high can be within far of it."""
    best = np.sqrt(np.maximum(size * size - far * far, 0))
    r = np.clip(np.where(size > far, best, low), low, high)
    return (size * size + r * r - far * far) / (2 * size * r)


def _rows(column: pa.Array, width: int, kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; very small and very large components keep theirs."""
    most = np.abs(x).max(1, keepdims=True)
    size = np.linalg.norm(x / most, axis=1, keepdims=True)
    return x / most / size, (most * size)[:, 0]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vec = pa.array([np.array(v, "<f4").tobytes() for v in b.column(1).to_pylist()], pa.binary())
        yield pa.record_batch([b.column(0), vec], names=["rep", "vec"])


MEMBER = "tbl int, bucket long, rep long, size double, slack double, vec binary"
DEALT = "grp int, role int, rep long, bucket long, size double, slack double, vec binary"
FOUND = "query long, rep long, low double, high double"
#: Rounding of distances in double precision, relative to the lengths of both vectors.
ROUNDING = 1e-7


def _members(hashing: CrossPolytope, width: int, tables: range):
    """Each vector once a table, with its bucket; vec: the unit vector in half precision, slack: the length of what that loses."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            unit, size = _unit(_rows(b.column(1), width))
            half = unit.astype("<f2")
            slack = np.linalg.norm(unit - half.astype(np.float64), axis=1) * size
            vec = pa.array([v.tobytes() for v in half], pa.binary())
            for t in tables:
                yield pa.record_batch([pa.array(np.full(len(b), t, np.int32)), pa.array(hashing.buckets(unit, t)), b.column(0), pa.array(size), pa.array(slack), vec], names=["tbl", "bucket", "rep", "size", "slack", "vec"])

    return work


class Layout:
    """The groups: from first[table, prefix] on, chunks[table, prefix] of them for each prefix of a bucket's number."""

    def __init__(self, hashing: CrossPolytope, prefix_bits: int, sizes: list[tuple[int, int, int]]):
        self.low, self.bits = hashing.bits - prefix_bits, prefix_bits
        self.chunks = np.zeros((hashing.tables, 1 << prefix_bits), np.int64)
        for table, prefix, n in sizes:
            self.chunks[table, prefix] = -(-n // GROUP)
        before = np.cumsum(self.chunks).reshape(self.chunks.shape)
        self.first, self.total = before - self.chunks, int(before[-1, -1])
        self.table_of = np.repeat(np.repeat(np.arange(hashing.tables), 1 << prefix_bits), self.chunks.ravel())


def _dealt_members(layout: Layout):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table, bucket, rep = (b.column(i).to_numpy() for i in range(3))
            prefix = bucket >> layout.low
            grp = layout.first[table, prefix] + rep % np.maximum(1, layout.chunks[table, prefix])
            yield pa.record_batch([pa.array(grp.astype(np.int32)), pa.array(np.zeros(len(b), np.int32)), b.column(2), b.column(1), b.column(3), b.column(4), b.column(5)], names=["grp", "role", "rep", "bucket", "size", "slack", "vec"])

    return work


def _dealt_queries(hashing: CrossPolytope, width: int, layout: Layout, tables: range):
    """Each query (rep, vec, radius) once to each group that holds a bucket within its radius; size holds the radius."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            radius = b.column(2).to_numpy()
            for at in range(0, len(b), 64):
                unit, own = _unit(_rows(b.column(1).slice(at, 64), width))[0], radius[at : at + 64]
                for t in tables:
                    near = hashing.prefix_gaps(hashing.gaps(unit, t), layout.bits) <= own[:, None]
                    row, prefix = np.nonzero(near & (layout.chunks[t] > 0))
                    n = layout.chunks[t, prefix]
                    grp = np.repeat(layout.first[t, prefix], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row = np.repeat(row, n) + at
                    for s in range(0, len(row), 5_000):
                        r, none = pa.array(row[s : s + 5_000]), len(row[s : s + 5_000])
                        yield pa.record_batch([pa.array(grp[s : s + 5_000].astype(np.int32)), pa.array(np.ones(none, np.int32)), b.column(0).take(r), pa.nulls(none, pa.int64()), b.column(2).take(r), pa.nulls(none, pa.float64()), b.column(1).take(r)], names=["grp", "role", "rep", "bucket", "size", "slack", "vec"])

    return work


class Chunk:
    """The members of one group or chunk, to be asked by queries."""

    def __init__(self, hashing: CrossPolytope, width: int, table: int, t: pa.Table):
        self.hashing, self.width, self.table = hashing, width, table
        self.rep, self.slack = t.column("rep").to_numpy(), t.column("slack").to_numpy()
        size = t.column("size").to_numpy()
        self.buckets, self.bucket = np.unique(t.column("bucket").to_numpy(), return_inverse=True)
        self.x = _rows(t.column("vec"), width, "<f2") * size[:, None]
        self.square = (self.x * self.x).sum(1)

    def ask(self, t: pa.RecordBatch, nearest: int) -> pa.RecordBatch:
        """What may be among the nearest of each query here, with bounds on its distance."""
        parts: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(t), 256):
            b = t.slice(at, 256)
            q, radius, rep = _rows(b.column(6), self.width), b.column(4).to_numpy(), b.column(2).to_numpy()
            gap = self.hashing.bucket_gaps(self.hashing.gaps(_unit(q)[0], self.table), self.buckets)
            asked = np.broadcast_to(gap <= radius[:, None], (len(q), len(self.buckets)))
            some = np.flatnonzero(asked.any(0)[self.bucket])
            if not len(some):
                continue
            own = (q * q).sum(1)
            square = own[:, None] + self.square[None, some] - 2 * (q @ self.x[some].T)
            loose = self.slack[some] + ROUNDING * (np.sqrt(own)[:, None] + np.sqrt(self.square[some]))
            far = np.sqrt(np.maximum(square, 0))
            high = np.where(asked[:, self.bucket[some]], far + loose, np.inf)
            last = np.partition(high, nearest, axis=1)[:, nearest] if len(some) > nearest else np.full(len(q), np.inf)
            i, j = np.nonzero((far - loose <= last[:, None]) & np.isfinite(high))
            parts.append((rep[i], self.rep[some[j]], np.maximum(far - loose, 0)[i, j], high[i, j]))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.record_batch(list(map(pa.array, columns)), names=["query", "rep", "low", "high"])


def _search(hashing: CrossPolytope, width: int, layout: Layout, nearest: int):
    """Rows sorted by group and role, members first, to FOUND. A task holds one group's members; queries stream past."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, chunk = -1, [], None
        for b in batches:
            if not len(b):
                continue
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(b)]
            for s, e in zip(cuts, cuts[1:]):
                part, grp = b.slice(s, e - s), int(key[s] >> 1)
                if grp != now:
                    now, members, chunk = grp, [], None
                if key[s] % 2 == 0:
                    members.append(part)
                    continue
                if chunk is None:
                    chunk = Chunk(hashing, width, int(layout.table_of[grp]), pa.Table.from_batches(members).combine_chunks())
                yield chunk.ask(part, nearest)

    return work


def _nearest(found: DataFrame, nearest: int) -> DataFrame:
    """(query, rep, low, high, last) of what may be among the nearest of a query and one more; last: that one's bound."""
    found = found.groupBy("query", "rep").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    by = Window.partitionBy("query")
    found = found.withColumn("place", F.row_number().over(by.orderBy("high", "rep")))
    last = F.max(F.when(F.col("place") == nearest + 1, F.col("high"))).over(by)
    return found.withColumn("last", last).where(F.col("last").isNull() | (F.col("low") <= F.col("last"))).drop("place")


def _asked(members: DataFrame, queries: DataFrame, hashing: CrossPolytope, width: int, tables: range, nearest: int, n: int) -> DataFrame:
    """FOUND of queries (rep, vec, radius) among members in some of the tables."""
    spark = members.sparkSession
    bits = min(hashing.bits, PREFIX_BITS, max(0, round(math.log2(max(1, n / GROUP)))))
    own = members.where(F.col("tbl").isin(list(tables)))
    sizes = own.groupBy("tbl", F.shiftright("bucket", hashing.bits - bits).alias("prefix")).count().collect()  # at most a row for a table and prefix
    layout = Layout(hashing, bits, [tuple(r) for r in sizes])
    dealt = own.mapInArrow(_dealt_members(layout), DEALT).union(queries.mapInArrow(_dealt_queries(hashing, width, layout, tables), DEALT))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp").sortWithinPartitions("grp", "role")
    return dealt.mapInArrow(_search(hashing, width, layout, nearest), FOUND)


def _radius(hashing: CrossPolytope, width: int, radii: np.ndarray, sizes: tuple[float, float]):
    """(rep, vec, last) to (rep, vec, radius)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            far, size = b.column(2).to_numpy(zero_copy_only=False), _unit(_rows(b.column(1), width))[1]
            cosine = np.where(np.isnan(far), -1.0, least_cosine(size, np.nan_to_num(far), *sizes))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(radius_at(radii, cosine))], names=["rep", "vec", "radius"])

    return work


def _sound(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, summed from the first component on."""
    square = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def nearest_neighbours(table: DataFrame, every: int = EVERY, nearest: int = NEAREST, miss: float = MISS, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest rows of each row whose vec_id is divisible by `every`.

    miss: the chance that a neighbour is in none of the buckets asked.
    """
    spark = table.sparkSession
    arrow_limits(spark)
    usable = table.where(F.col("vec_id").isNotNull() & _sound(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = usable.withColumn("place", place).where(F.col("place") <= nearest + 1)
    reps = few.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = stored(reps, "vectors")
    asking = usable.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    asking = stored(asking.join(reps, "embedding").select("query_id", F.col("rep").alias("query")), "queries")
    found = []
    for width, n in reps.groupBy(F.size("embedding")).count().collect():  # a row for each length of vector
        own = reps.where(F.size("embedding") == width).select("rep", "embedding").mapInArrow(_packed, "rep long, vec binary")
        bits = max(0, round(math.log2(max(1, n / BUCKET_ROWS))))
        hashing = CrossPolytope(width, bits, tables)
        members = stored(own.mapInArrow(_members(hashing, width, range(tables)), MEMBER), "members")
        sizes = members.where("tbl = 0").agg(F.min("size"), F.max("size")).first()
        wanted = own.join(asking.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi")
        alone, radii = hashing.radii(miss, miss ** (1 / tables))
        first = float(radius_at(alone, np.array([FIRST]))[0])
        soon = stored(_asked(members, wanted.withColumn("radius", F.lit(first)), hashing, width, range(1), nearest, n), "found")
        bound = _nearest(soon, nearest).groupBy(F.col("query").alias("rep")).agg(F.max("last").alias("last"))
        radius = wanted.join(bound, "rep", "left").select("rep", "vec", "last").mapInArrow(_radius(hashing, width, radii, tuple(sizes)), "rep long, vec binary, radius double")
        found.append(stored(_asked(members, radius, hashing, width, range(tables), nearest, n), "found"))
        found.append(soon)
    empty = spark.createDataFrame([], FOUND)
    rows = empty
    for more in found:
        rows = rows.union(more)
    rows = _nearest(rows, nearest).select("query", "rep")
    asked = reps.select(F.col("rep").alias("query"), F.col("embedding").alias("own"))
    exact = rows.join(reps, "rep").join(asked, "query").select("query", distance(F.col("own"), F.col("embedding")).alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    best = exact.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nearest + 1)
    best = stored(best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best")), "best")
    out = asking.join(best, "query")
    mine = F.array_position(F.transform("best", lambda x: x["vec_id"]), F.col("query_id"))  # 0: others are as near and have smaller ids
    others = F.filter("best", lambda x, i: i + 1 != F.col("mine"))
    out = out.withColumn("mine", mine).select("query_id", F.posexplode(F.slice(others, 1, nearest)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


#: All distances by brute force; the multiprobe search is right where it equals this.
NEIGHBOURS_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM pair QUALIFY rank <= {NEAREST}
"""
