"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table-lookup distances, exact rerank.

Equal vectors are one row from the start, with their number. Coarse centroids and the codebooks of PARTS
subspaces are fitted on SAMPLE vectors (the smallest hashes of vec_id); every vector is then indexed. A vector's
home list is its nearest centroid's, and a list's radius is the largest angle between a member and its centroid.
A link is at most acos(threshold) wide, so a list can hold one only where the query's angle to the centroid is
at most the radius plus that: all such lists are visited, and no link is lost. In a list, a query's table of inner
products with the codewords gives its approximate cosine to each member; the member's own code error bounds how
far off that is, so only pairs that can reach the threshold go to the exact cosine in double precision.

Lists make groups of about GROUP members, a list of over CHUNK members in chunks, so a dense region with a third of
all rows is many tasks. A query is sent once to a group, and of two groups one is sent to the other, so a pair is
seen from one side. A task holds a group's members; queries stream past. Where no list can be ruled out (vectors
without clusters) all pairs are looked up, so work grows with the square there. Links aren't listed: tasks give
each vector's number of links and, for components, a spanning star.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without
vec_id; they are returned with 0 links as their own component. Vectors of different lengths don't link. Repeated
rows count as other vectors. An empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, components, local_stars, stored

THRESHOLD = 0.9
SAMPLE, LIST_ROWS, LISTS = 20_000, 256, 4_096
PARTS, WORDS, CHUNK, GROUP, ROUNDS = 8, 256, 1_024, 4_096, 10


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids (fewer rows: the rows), from evenly spaced rows."""
    if len(x) <= k:
        return x.copy()
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centre)
    return centre


class Index:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centre = _kmeans(sample, lists)
        residual = sample - self.centre[self.nearest(sample, 1)[:, 0]]
        width = sample.shape[1]
        cuts = np.linspace(0, width, min(PARTS, width) + 1).astype(int)
        self.parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        self.words = [_kmeans(residual[:, a:z], WORDS) for a, z in self.parts]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids, nearest first (ties: the lower number)."""
        return np.argsort(-(x @ self.centre.T - 0.5 * (self.centre * self.centre).sum(1)), axis=1, kind="stable")[:, :n].astype(np.int32)

    def encode(self, x: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a list's members, and the length of what the codes leave out."""
        residual = x - self.centre[home]
        codes = np.stack([(residual[:, a:z] @ w.T - 0.5 * (w * w).sum(1)).argmax(1) for (a, z), w in zip(self.parts, self.words)], axis=1)
        coded = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return codes, np.linalg.norm(residual - coded, axis=1)

    def approximate(self, queries: np.ndarray, codes: np.ndarray, home: int) -> np.ndarray:
        """Inner products of queries with coded members, by table look-up."""
        out = np.repeat((queries @ self.centre[home])[:, None].astype(np.float32), len(codes), axis=1)
        for i, ((a, z), w) in enumerate(zip(self.parts, self.words)):
            out += np.take((queries[:, a:z] @ w.T).astype(np.float32), codes[:, i], axis=1)
        return out


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # very small and very large components keep their length
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(column: pa.Array) -> pa.Array:
    return pa.array([np.array(v, "<f4").tobytes() for v in column.to_pylist()], pa.binary())


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), _packed(b.column(2))], names=["rep", "copies", "vec"])


HOMED = "rep long, copies long, home int, angle double, vec binary"
DEALT = "grp int, role int, rep long, copies long, home int, vec binary"
#: Angles are compared with this much slack, looked-up cosines with the other.
SLACK, LOOSE = 1e-6, 1e-5


def _angles(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles between unit vectors and centroids; a centroid of length zero is at a right angle to all."""
    size = np.linalg.norm(centre, axis=1)
    return np.arccos(np.clip(x @ (centre / np.where(size > 0, size, 1)[:, None]).T, -1, 1))


def _homes(index: Index, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _unit(b.column(2), width)
                home = index.nearest(x, 1)[:, 0]
                angle = _angles(x, index.centre)[np.arange(len(b)), home]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(home), pa.array(angle), b.column(2)], names=["rep", "copies", "home", "angle", "vec"])

    return work


class Layout:
    """Which lists, and chunks of large ones, make a group, and how far each list's members reach from its centroid."""

    def __init__(self, index: Index, sizes: list[tuple[int, int, float]], threshold: float):
        lists = len(index.centre)
        self.chunks = np.zeros(lists, np.int64)
        self.reach = np.zeros(lists)
        rows = np.zeros(lists, np.int64)
        for k, n, radius in sizes:
            self.chunks[k], rows[k] = -(-n // CHUNK), n
            self.reach[k] = radius + np.arccos(min(1.0, max(-1.0, threshold))) + SLACK
        # near centroids lie side by side, so that a query meets few groups
        most = max(1, int(rows.sum()) // GROUP)
        coarse = _kmeans(index.centre, most)
        place = (index.centre @ coarse.T - 0.5 * (coarse * coarse).sum(1)).argmax(1)
        order = np.lexsort((np.arange(lists), place))
        self.unit_list = np.repeat(order, self.chunks[order])
        unit_rows = rows[self.unit_list] / self.chunks[self.unit_list]
        group = ((np.cumsum(unit_rows) - unit_rows) // GROUP).astype(np.int64)
        self.unit_group = np.unique(group, return_inverse=True)[1]
        self.starts = np.searchsorted(self.unit_group, np.arange(self.unit_group.max() + 1))
        self.first_unit = np.full(lists, -1)
        seen, at = np.unique(self.unit_list, return_index=True)
        self.first_unit[seen] = at

    def own(self, home: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """The group of each member."""
        return self.unit_group[self.first_unit[home] + rep % self.chunks[home]]

    def visits(self, angles: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, group) for each other group that can hold a link, from one of the two sides of each pair of groups."""
        can = np.logical_or.reduceat((angles <= self.reach)[:, self.unit_list], self.starts, axis=1)
        g = np.arange(len(self.starts))
        mine = own[:, None]
        # of two groups the lower goes to the higher where their sum is even, else the other way
        return np.nonzero(can & (mine != g) & ((mine < g) == ((mine + g) % 2 == 0)))


def _dealer(index: Index, width: int, layout: Layout):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            rep, copies, home = (b.column(i).to_numpy() for i in range(3))
            own = layout.own(home, rep)
            query, group = layout.visits(_angles(_unit(b.column(4), width), index.centre), own)
            row, group = np.concatenate([np.arange(len(b)), query]), np.concatenate([own, group])
            role = (np.arange(len(row)) >= len(b)).astype(np.int32)
            for at in range(0, len(row), 10_000):
                r = row[at : at + 10_000]
                cols = [group[at : at + 10_000].astype(np.int32), role[at : at + 10_000], rep[r], copies[r], home[r]]
                yield pa.record_batch([*map(pa.array, cols), b.column(4).take(pa.array(r))], names=["grp", "role", "rep", "copies", "home", "vec"])

    return work


class Group:
    """The members of a group, what queries find among them, and their components so far."""

    def __init__(self, index: Index, width: int, threshold: float, layout: Layout, t: pa.Table):
        self.index, self.width, self.threshold, self.layout = index, width, threshold, layout
        home = t.column("home").to_numpy()
        order = np.argsort(home, kind="stable")
        self.rep, self.copies = t.column("rep").to_numpy()[order], t.column("copies").to_numpy()[order]
        self.x, home = _unit(t.column("vec"), width)[order], home[order]
        self.links, self.label = np.zeros(len(order), np.int64), np.arange(len(order))
        names, starts = np.unique(home, return_index=True)
        self.lists = []
        for k, s, e in zip(names.tolist(), starts, [*starts[1:], len(home)]):
            self.lists.append((k, s, e, *index.encode(self.x[s:e], k)))
        for at in range(0, len(order), 2_000):
            rows = np.arange(at, min(at + 2_000, len(order)))
            self.links[rows] += self._search(self.x[rows], rows, None)

    def _merge(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = label[a] != label[b]
        if not far.any():
            return label
        ids, low = local_stars(label[a[far]], label[b[far]])
        to = np.arange(len(label))
        to[ids] = low
        return to[label]

    def _search(self, x: np.ndarray, node: np.ndarray, copies: np.ndarray | None) -> np.ndarray:
        """Links of queries; members (copies is None) are at node, others come after the members in label."""
        links = np.zeros(len(x), np.int64)
        angles = _angles(x, self.index.centre[[k for k, *_ in self.lists]])
        for n, (k, s, e, codes, error) in enumerate(self.lists):
            q = np.flatnonzero(angles[:, n] <= self.layout.reach[k])
            for s2 in range(s, e, CHUNK) if len(q) else ():
                e2 = min(e, s2 + CHUNK)
                i, j = self._hits(x[q], node[q], s2, e2, self.index.approximate(x[q], codes[s2 - s : e2 - s], k) + error[s2 - s : e2 - s])
                if not len(i):
                    continue
                links[q] += np.bincount(i, weights=self.copies[s2 + j], minlength=len(q)).astype(np.int64)
                if copies is not None:
                    self.links[s2:e2] += np.bincount(j, weights=copies[q[i]], minlength=e2 - s2).astype(np.int64)
                a, b = node[q[i]], s2 + j
                first = np.concatenate([np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]])
                self.label = self._merge(self._merge(self.label, a[first], b[first]), a, b)
        return links

    def _hits(self, x: np.ndarray, node: np.ndarray, s: int, e: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (bound >= self.threshold - LOOSE) & (node[:, None] != np.arange(s, e))
        if np.count_nonzero(near) * 16 > near.size:  # a dense block: most pairs are settled by one product
            product = x @ self.x[s:e].T
            near &= product >= self.threshold - 1e-12
            i, j = np.nonzero(near)
            unsure = np.flatnonzero(product[i, j] < self.threshold + 1e-12)
        else:
            i, j = np.nonzero(near)
            unsure = np.arange(len(i))
        keep = np.ones(len(i), bool)
        for at in range(0, len(unsure), 100_000):
            u = unsure[at : at + 100_000]
            keep[u] = np.einsum("ij,ij->i", x[i[u]], self.x[s + j[u]]) >= self.threshold
        return i[keep], j[keep]

    def ask(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """What rows of other groups link with here."""
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        m = len(self.rep)
        self.label = np.concatenate([self.label, m + np.arange(len(t))])
        links = self._search(_unit(t.column("vec"), self.width), m + np.arange(len(t)), copies)
        to, self.label = self.label[m:], self.label[:m]
        some = np.flatnonzero(links)  # a query that links has the label of a member
        yield _rows(rep[some], links[some], self.rep[to[some]])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield _rows(self.rep, self.links, self.rep[self.label])


def _rows(rep: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rep), pa.array(links), pa.array(other)], names=["rep", "links", "other"])


def _found(index: Index, width: int, threshold: float, layout: Layout):
    """Rows sorted by group and role, members first, to (rep, links, other): links to count, and an edge of a star."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, group = -1, [], None

        def built() -> Group:
            return Group(index, width, threshold, layout, pa.Table.from_batches(members).combine_chunks())

        for b in batches:
            if not len(b):
                continue
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(b)]
            for s, e in zip(cuts, cuts[1:]):
                part, grp = b.slice(s, e - s), int(key[s] >> 1)
                if grp != now:
                    if now >= 0:
                        yield from (group or built()).end()
                    now, members, group = grp, [], None
                if key[s] % 2 == 0:
                    members.append(part)
                else:
                    group = group or built()
                    yield from group.ask(pa.Table.from_batches([part]))
        if now >= 0:
            yield from (group or built()).end()

    return work


def vector_components(table: DataFrame, threshold: float = THRESHOLD, probes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; probes has no effect, all lists that can hold a link are visited."""
    spark = table.sparkSession
    arrow_limits(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("embedding")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = table.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    reps = stored(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    widths = reps.groupBy(F.size("embedding").alias("w")).count().collect()  # a row for each length of vector
    found = []
    for width, n in widths:
        own = reps.where(F.size("embedding") == width)
        packed = own.select("rep", "copies", "embedding").mapInArrow(_to_bytes, "rep long, copies long, vec binary")
        first = own.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "copies", "embedding").toPandas()
        sample = _unit(pa.array([np.array(x, "<f4").tobytes() for x in first["embedding"]]), width)
        index = Index(sample, max(1, min(LISTS, n // LIST_ROWS)))
        homed = stored(packed.mapInArrow(_homes(index, width), HOMED), "homes")
        sizes = homed.groupBy("home").agg(F.count("*"), F.max("angle")).collect()  # a row a list
        layout = Layout(index, [tuple(r) for r in sizes], threshold)
        dealt = homed.mapInArrow(_dealer(index, width, layout), DEALT)
        dealt = dealt.repartition(n_parts, "grp").sortWithinPartitions("grp", "role")
        found.append(stored(dealt.mapInArrow(_found(index, width, threshold, layout), "rep long, links long, other long"), "found"))
    if not found:
        return table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    counts = rows.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(rows.where("other <> rep").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    result = reps.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    result = stored(result.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "linked")
    result = result.withColumnRenamed("embedding", "own")
    keyed = table.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("embedding").cast("array<float>")).alias("key"))
    out = keyed.join(result, F.col("key") == F.col("own"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: All pairs by brute force; the query's approximate search is right where it equals this.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 AND isfinite(a.size) AND isfinite(b.size) AND list_dot_product(a.e, b.e) >= 0.9 * a.size * b.size),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT r.x AS vec_id, (SELECT count(*) FROM link WHERE link.x = r.x) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM reach r GROUP BY r.x
"""
