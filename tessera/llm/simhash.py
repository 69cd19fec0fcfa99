"""Near-duplicates by SimHash: banded exact matches, a pivot distance table, and verified Hamming distances.

Documents become one 64-bit fingerprint of their word shingles. Equal fingerprints are one row from then on.
Two fingerprints within RADIUS bits agree wholly in all but RADIUS of B blocks, so each goes into a bucket for each
choice of B - RADIUS of them: 15 for six blocks (22 bits a bucket), and more blocks, with more bits, for more rows.
In a bucket the Hamming distances to PIVOTS reference fingerprints are a table; by the triangle inequality a
pair whose distances to any reference differ by more than the radius is no link. What is left is verified.
A bucket of over HEAVY fingerprints is dealt anew by four of eight parts of the bits outside its key, which
loses no link either. Tasks report each bucket's components as stars, never its pairs.

Null texts count as empty, a text without words has fingerprint zero, equal texts have equal fingerprints,
and an empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, components, local_stars, mix, numbers, plain_names, stored, text_or_empty

RADIUS = 4
PIVOTS = 24
#: (rows from which, number of blocks): 2, 3 or 4 blocks agree, of 22, 27 or 32 bits together, for 15, 35 or 70 keys.
BLOCKS_FROM = ((0, 6), (1 << 29, 7), (1 << 34, 8))
HEAVY = 4_096
#: Pairs that a task holds before their components stand for them.
DENSE = 1 << 17
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of a text's shingles of lower-cased words, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts]).tolist()
    ends = (ends - 1).tolist()[words - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 8_192):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + 8_192], ends[at : at + 8_192])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    arrow_limits(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(work, "doc_id long, fp long")


def _bits(x: np.ndarray, first: int, width: int) -> np.ndarray:
    return (x >> np.uint64(first)) & np.uint64((1 << width) - 1)


def blocks_of(number: int) -> list[tuple[int, int]]:
    """First bit and width of so many blocks of a fingerprint."""
    cuts = [64 * i // number for i in range(number + 1)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:])]


def _bucket_keys(fp: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    """(bucket, fp, rep), a row for each choice of all but RADIUS blocks: their bits (32 at most) and which choice."""
    part = [F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)) for first, width in blocks]
    keys = []
    for k, chosen in enumerate(combinations(range(len(blocks)), len(blocks) - RADIUS)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, blocks[i][1]).bitwiseOR(part[i])
        keys.append(F.shiftleft(key, 7).bitwiseOR(F.lit(k).cast("long")))
    return fp.select(F.explode(F.array(*keys)).alias("bucket"), "fp", "rep")


def _finer(batches: Iterator[pa.RecordBatch], blocks: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of heavy buckets, 70 for each: four of eight parts of the bits outside the bucket's blocks."""
    choices = list(combinations(range(len(blocks)), len(blocks) - RADIUS))
    for b in batches:
        bucket, fp, rep = (b.column(i).to_numpy() for i in range(3))
        out, u = [], fp.view(np.uint64)
        for k in np.unique(bucket & 127):
            rows = (bucket & 127) == k
            x, rest = u[rows], [(f, w) for i, (f, w) in enumerate(blocks) if i not in choices[k]]
            halves = [h for f, w in rest for h in ((f, w // 2), (f + w // 2, w - w // 2))]
            for n, four in enumerate(combinations(range(8), 4)):
                key = mix(bucket[rows].astype(np.uint64) * np.uint64(71) + np.uint64(n))
                for i in four:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + _bits(x, *halves[i]))
                out.append((key.view(np.int64), fp[rows], rep[rows]))
        for key, f, r in out:
            yield pa.record_batch([pa.array(key), pa.array(f), pa.array(r)], names=["bucket", "fp", "rep"])


def linked(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within the radius, for rows sorted by group; in slices, one forest for each."""
    u = fp.view(np.uint64)
    table = np.stack([np.bitwise_count(u ^ p) for p in numbers(PIVOTS, 7)], axis=1).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    u, table, group = u[order], table[order], group[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    i, step, kept = np.arange(len(u)), 1, 0
    while True:
        i = i[i + step < len(u)]
        j = i + step
        near = (group[i] == group[j]) & (table[j, 0] - table[i, 0] <= radius)  # sorted: what follows is farther
        i, j = i[near], j[near]
        if not len(i):
            break
        near = np.abs(table[i] - table[j]).max(1) <= radius
        a, b = i[near], j[near]
        near = np.bitwise_count(u[a] ^ u[b]) <= radius
        found.append((a[near], b[near]))
        kept += int(near.sum())
        if kept > DENSE:  # a dense bucket: its forest so far stands for its pairs
            found = [local_stars(*map(np.concatenate, zip(*found)))]
            kept = len(found[0][0])
        step += 1
    if not found:
        return order[:0], order[:0]
    a, b = map(np.concatenate, zip(*found))
    return order[a], order[b]


def _links(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket; a bucket may go on in the next batch."""
        rest: list[np.ndarray] | None = None

        def of(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = linked(cols[1], cols[0], radius)
            src, dst = local_stars(cols[2][a], cols[2][b]) if len(a) else (cols[2][:0], cols[2][:0])
            return pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = np.searchsorted(cols[0], cols[0][-1])
            if cut >= 50_000:
                yield of([c[:cut] for c in cols])
                cols = [c[cut:] for c in cols]
            rest = cols
        if rest is not None:
            yield of(rest)

    return work


def fingerprint_components(fps: DataFrame, radius: int = RADIUS, number: int | None = None, heavy_rows: int = HEAVY) -> DataFrame:
    """(doc_id, fp) to (fp, component): the smallest doc_id that links of at most `radius` bits (RADIUS at most) reach.

    number (of blocks; by default by the number of rows) and heavy_rows don't change the result.
    """
    spark = fps.sparkSession
    arrow_limits(spark)
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    if number is None:
        rows = reps.count()
        number = max(blocks for least, blocks in BLOCKS_FROM if rows >= least)
    blocks = blocks_of(number)
    keys = _bucket_keys(reps.where("rep is not null"), blocks)
    heavy = stored(keys.groupBy("bucket").count().where(F.col("count") > heavy_rows).select("bucket", F.lit(True).alias("heavy")), "heavy")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if heavy.isEmpty():
        dealt = keys
    else:
        marked = keys.join(heavy, "bucket", "left").select("bucket", "fp", "rep", "heavy")
        finer = marked.where("heavy").select("bucket", "fp", "rep").mapInArrow(lambda b: _finer(b, blocks), "bucket long, fp long, rep long")
        dealt = marked.where("heavy is null").select("bucket", "fp", "rep").union(finer)
    sorted_rows = dealt.repartition(n, "bucket").sortWithinPartitions("bucket")
    edges = sorted_rows.mapInArrow(_links(radius), "src long, dst long")
    groups = components(edges)
    joined = reps.join(groups, reps["rep"] == groups["node"], "left")
    return stored(joined.select("fp", F.coalesce("component", "rep").alias("component")), "components")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    fps = stored(fingerprints(docs, words), "simhash")
    groups = fingerprint_components(fps, radius)
    fps = fps.join(groups, "fp")
    return fps.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Near copies: five-word shingles, and the least Jaccard similarity of their sets as a fraction.
WIDE_WORDS, LEAST = 5, (4, 5)
#: MinHash: documents that agree in all ROWS bytes of one of BANDS bands are candidates. At a similarity of 0.8 a pair
#: is none with a chance of (1 - 0.8 ** 4) ** 20, 1 in 38,000; at 0.9, of 1 in 10 ** 9.
BANDS, ROWS = 20, 4
#: Bytes of a signature that a candidate has to share; at 0.8, 64 of 80 are expected (standard deviation 3.6).
SHARED = 44
#: One odd number for each of the hashes that are derived from one hash.
DERIVED = numbers(BANDS * ROWS, 99) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles of lower-cased words; of a shorter text one, without words none."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    sizes = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes).tolist(), (ends - 1).tolist()[WIDE_WORDS - 1 :] or [len(line)]
    return np.unique(np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(ends)))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def signature(hashes: np.ndarray) -> bytes:
    """A byte of each of the set's MinHash values."""
    low = np.full(len(DERIVED), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1_024):
        np.minimum(low, mix(hashes[at : at + 1_024, None] * DERIVED[None]).min(0), out=low)
    return low.astype(np.uint8).tobytes()


def _signatures(docs: DataFrame) -> DataFrame:
    arrow_limits(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            ids = np.array([set_id(x) for x in sets], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(ids), pa.array([signature(x) for x in sets], pa.binary())], names=["doc_id", "sid", "sig"])

    return docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(work, "doc_id long, sid long, sig binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, sig) to (bucket, sid): the band's number and its bytes."""
    for b in batches:
        words = np.frombuffer(b"".join(b.column(1).to_pylist()), f"<u{ROWS}").reshape(len(b), BANDS).astype(np.int64)
        keys = words | (np.arange(BANDS, dtype=np.int64) << 32)
        yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "sid"])


def _candidates(x: np.ndarray, y: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    """Whether rows of signatures can be near copies and agree in this band first, so that a pair is named once."""
    same = x == y
    whole = same.reshape(*same.shape[:-1], BANDS, ROWS).all(-1)
    return (same.sum(-1) >= SHARED) & (whole.argmax(-1) == band)


def _sig_array(t: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to pairs of each with its bucket's first."""
    key, sid, sig = -1, 0, np.zeros(BANDS * ROWS, np.uint8)
    for b in batches:
        if not len(b):
            continue
        keys, ids, sigs = b.column("bucket").to_numpy(), b.column("sid").to_numpy(), _sig_array(b)
        first = np.searchsorted(keys, keys)
        head, head_sig = ids[first], sigs[first]
        going_on = keys == key
        head[going_on], head_sig[going_on] = sid, sig
        some = (head != ids) & _candidates(head_sig, sigs, keys >> 32)
        a, z = np.minimum(head, ids)[some], np.maximum(head, ids)[some]
        yield pa.record_batch([pa.array(a), pa.array(z)], names=["a", "b"])
        key, sid, sig = int(keys[-1]), int(head[-1]), head_sig[-1].copy()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets of shingles have a Jaccard similarity of LEAST or more, exactly."""
    for b in batches:
        ok = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            ok.append(both * LEAST[1] >= ((len(x) + len(y)) // 8 - both) * LEAST[0])
        yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) of the candidate pairs (a, b) that are near copies; sets: (sid, hashes)."""
    x, y = (sets.select(F.col("sid").alias(k), F.col("hashes").alias(h)) for k, h in (("a", "x"), ("b", "y")))
    whole = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return stored(whole.mapInArrow(_similar, "a long, b long").select(F.col("a").alias("src"), F.col("b").alias("dst")), "near_links")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, hashes) of the documents whose set is wanted (sid, doc_id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            ids = np.array([set_id(x) for x in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(ids), pa.array([x.tobytes() for x in sets], pa.binary())], names=["sid", "hashes"])

    texts = docs.select("doc_id", text_or_empty(docs).alias("text")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.select("text").mapInArrow(work, "sid long, hashes binary")
    return stored(found.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "near_sets")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by column 0 to a table for each of its values."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:]):
            if rest and e > s and rest[-1].column(0)[0].as_py() != key[s]:
                yield pa.Table.from_batches(rest)
                rest = []
            if e > s:
                rest.append(b.slice(s, e - s))
    if rest:
        yield pa.Table.from_batches(rest)


class Sets:
    """The sets of shingles of a block's rows as bits, over the shingles that two rows or more have."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        width = -(-max(1, int((times > 1).sum())) // 64) * 64
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        ends = np.cumsum(self.sizes)
        for row, (s, e) in enumerate(zip(ends - self.sizes, ends)):
            own = place[s:e]
            flags = np.zeros(width, bool)
            flags[column[own[times[own] > 1]]] = True
            self.bits[row] = np.packbits(flags).view(np.uint64)

    def both(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many shingles rows i have in common with other rows j."""
        step = max(1, (4 << 20) // (8 * self.bits.shape[1]))
        parts = [np.bitwise_count(self.bits[i[a : a + step]] & self.bits[j[a : a + step]]).sum(1, dtype=np.int64) for a in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def table(self, pivots: int) -> np.ndarray:
        """The Jaccard distances (a metric) of all rows to some of them."""
        n = len(self.sizes)
        out = []
        for p in np.unique(np.linspace(0, n - 1, min(pivots, n)).astype(int)):
            both = self.both(np.arange(n), np.full(n, p))
            both[p] = self.sizes[p]
            out.append(1 - both / np.maximum(1, self.sizes + self.sizes[p] - both))
        return np.stack(out, axis=1)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a bucket's rows (block, bucket, side, sid, label, sig, hashes) to links between different labels.

    side is -1 in a block whose rows all meet each other, else 0 and 1 meet. The distances to PIVOTS reference rows
    are a table, pairs that differ by more than a link's distance in any of them are discarded, the others verified.
    A pair is looked at in the first band that it agrees in, and only while its labels still differ.
    """
    most = 1 - LEAST[0] / LEAST[1] + 1e-9
    for t in _one_by_one(batches):
        band = t.column("bucket")[0].as_py() >> 32
        ids, label, side = (t.column(k).to_numpy() for k in ("sid", "label", "side"))
        sigs, sets = _sig_array(t), Sets([np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()])
        table, n, found = sets.table(PIVOTS), len(t), []
        step = max(1, (1 << 15) // n)
        for at in range(0, n, step):
            rows = slice(at, at + step)
            near = np.arange(n)[None] > np.arange(n)[rows, None]
            near &= label[rows, None] != label[None]
            near &= (side[rows, None] < 0) | (side[rows, None] != side[None])
            i, j = np.nonzero(near)
            i += at
            for k in range(table.shape[1]):
                keep = np.abs(table[i, k] - table[j, k]) <= most
                i, j = i[keep], j[keep]
            keep = _candidates(sigs[i], sigs[j], band)
            i, j = i[keep], j[keep]
            both = sets.both(i, j)
            keep = both * LEAST[1] >= (sets.sizes[i] + sets.sizes[j] - both) * LEAST[0]
            i, j = i[keep], j[keep]
            if len(i):
                found.append(local_stars(ids[i], ids[j]))
                old, new = local_stars(label[i], label[j])
                order = np.argsort(old)
                old, new = old[order], new[order]
                spot = np.minimum(np.searchsorted(old, label), len(old) - 1)
                label = np.where(old[spot] == label, new[spot], label)
        if found:
            src, dst = local_stars(*map(np.concatenate, zip(*found)))
            yield pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])


def _blocks(marked: DataFrame, sets: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(block, bucket, side, sid, label, sig, hashes): the rows that have to meet, of buckets with different labels.

    Rows with the label of their bucket's first row are its main ones; these don't meet each other. Main and other rows
    are each cut into parts of about `block` rows and `block_bytes` bytes; two parts are a block.
    """
    heads = marked.groupBy("bucket").agg(F.min_by("label", "sid").alias("first_label"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    heads = stored(heads.where("lo <> hi").select(F.col("bucket").alias("of_bucket"), "first_label"), "near_heads")
    rows = marked.join(heads, F.col("bucket") == F.col("of_bucket")).select("bucket", "sid", "label", (F.col("label") == F.col("first_label")).alias("main"))
    rows = stored(rows.join(sets.select("sid", F.length("hashes").alias("size")), "sid"), "near_open")
    parts = lambda rule: F.greatest(F.ceil(F.count(F.when(rule, 1)) / block), F.ceil(F.coalesce(F.sum(F.when(rule, F.col("size"))), F.lit(0)) / block_bytes)).cast("int")
    counts = stored(rows.groupBy("bucket").agg(parts(F.col("main")).alias("mains"), parts(~F.col("main")).alias("rests")), "near_parts")
    rows = rows.join(counts.withColumnRenamed("bucket", "of_bucket"), F.col("bucket") == F.col("of_bucket"))
    small = (F.col("mains") == 1) & (F.col("rests") == 1)
    part = F.pmod(F.xxhash64("sid"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    entry = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    others = F.sequence(F.lit(0), F.col("rests") - 1)
    with_rests = F.transform(others, lambda d: entry(1, F.least(d, part), F.greatest(d, part), F.when(d == part, -1).otherwise((part > d).cast("int"))))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda d: entry(2, part, d, F.lit(0)))
    of_main = F.transform(others, lambda d: entry(2, d, part, F.lit(1)))
    where = F.when(small, F.array(entry(0, F.lit(0), F.lit(0), F.lit(-1)))).when(F.col("main"), of_main).otherwise(F.concat(with_rests, with_mains))
    dealt = rows.select("bucket", "sid", "label", F.explode(where).alias("to"))
    keyed = dealt.select(F.xxhash64("bucket", "to.kind", "to.x", "to.y").alias("block"), "bucket", "to.side", "sid", "label")
    return stored(keyed, "near_blocks").join(sets, "sid").select("block", "bucket", "side", "sid", "label", "sig", "hashes")


#: Rows and bytes of sets of shingles that a part of a bucket has.
PART_ROWS, PART_BYTES = 512, 16 << 20


def near_links(docs: DataFrame, reps: DataFrame, block: int = PART_ROWS, block_bytes: int = PART_BYTES) -> DataFrame:
    """(src, dst) between sets of shingles: the components of all pairs of a Jaccard similarity of 0.8 or more.

    reps: (sid, sig, rep). First each row of a bucket meets the bucket's first, then rows that these links haven't
    joined meet each other, in blocks of a bounded size (block, block_bytes; the result is the same), each in a task.
    So a large group of near copies is not listed pair by pair, and no pair is left out.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = reps.select("sid", "sig").mapInArrow(_banded, "bucket long, sid long")
    shared = stored(keys.groupBy("bucket").count().where("count > 1").select("bucket"), "shared")
    rows = stored(keys.join(shared, "bucket").join(reps.select("sid", "sig"), "sid").select("bucket", "sid", "sig"), "near_buckets")
    wanted = reps.join(rows.select("sid").distinct(), "sid", "left_semi").select("sid", F.col("rep").alias("doc_id"))
    sets = _sets(docs, wanted)
    stars = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "sid").mapInArrow(_to_first, "a long, b long")
    links = _verified(stars.distinct(), sets)
    label = components(links).select(F.col("node").alias("sid"), F.col("component").alias("label"))
    marked = stored(rows.select("bucket", "sid").join(label, "sid", "left").select("bucket", "sid", F.coalesce("label", "sid").alias("label")), "near_labels")
    signed = stored(sets.join(reps.select("sid", "sig"), "sid"), "near_signed")
    blocks = _blocks(marked, signed, block, block_bytes)
    others = blocks.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_block_links, "src long, dst long")
    return links.union(stored(others, "near_others"))


def without_near_copies(docs: DataFrame, block: int = PART_ROWS) -> DataFrame:
    """The documents less near copies: of each group that similar documents link, the smallest doc_id stays.

    Similar: the sets of distinct five-word shingles have a Jaccard similarity of 0.8 or more, computed for every
    candidate pair. Candidates agree in one of BANDS bands of MinHash values, whatever the size of the bucket.
    Texts without a word are one group, rows without doc_id stay, and so do all rows of a doc_id that stays.
    """
    sketches = stored(_signatures(docs), "sketches")
    reps = stored(sketches.where("doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "sketch_groups")
    links = near_links(docs, reps, block)
    # a group stands for its smallest doc_id
    ids = [reps.select(F.col("sid").alias(c), F.col("rep").alias(f"{c}_rep")) for c in ("src", "dst")]
    edges = links.join(ids[0], "src").join(ids[1], "dst").select(F.col("src_rep").alias("src"), F.col("dst_rep").alias("dst"))
    groups = components(edges)
    kept = reps.join(groups, reps["rep"] == groups["node"], "left").where("component is null or component = rep")
    kept = stored(kept.select(F.col("rep").alias("kept_id")), "kept")
    names, plain = docs.columns, plain_names(docs, "doc_id")
    out = plain.join(kept, plain["doc_id"] == kept["kept_id"], "left").where("kept_id is not null or doc_id is null")
    return out.select(*plain.columns).toDF(*names)
