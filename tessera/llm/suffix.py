"""Exact removal of repeated passages: sampled suffixes, named, sorted, merged, adjacent prefixes compared.

A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a document of smaller doc_id,
or at an earlier start of the same one. Only suffixes that agree in their first WINDOW bytes matter, so
suffixes are sorted to that depth.

The sample isn't a positional difference cover (README has the measured sizes of such covers). It is fixed by
content (winnowing): a window's sample is the leftmost smallest of its 64 names of 37 bytes. Equal windows hold
their sample at the same offset, which is what a difference cover is for; about one position in 30 is sampled.

1. Sample. Each window belongs to one sample; a sample is a row (name, whole, place).
2. Sort the samples by a triple: the name of their 37 bytes, the name of all bytes that their windows touch,
   and their place. A name that occurs once ends all its windows. Of equal second names all but the first
   place are repeats in full. Both need 24 bytes a sample, no text.
3. Go on with what is left: samples with equal first but different second names, with their bytes.
4. Merge the other suffixes: a window is its offset before its sample, followed by the sample's suffix. Sorted
   by name and then by place, a window is a repeat when its neighbour before has the same name.
5. The windows of a first name that very many different samples share go by their own names instead, without
   bytes, after each task has settled its own; so one passage in a third of all documents makes a row a task.
   A task that meets LOCAL different samples of a name in one go sends only a mark for it, and its samples
   under names of their own, so that no task gets all samples of a common phrase.

The first name is a hash modulo 2**64, the second one of two prime moduli with bases of their own (62 bits);
repeats agree in both. Null texts count as empty. Texts under WINDOW bytes keep all; very long texts are worked
on in slices of SLICE windows. Of equal texts the smallest doc_id keeps its own. Rows that repeat a doc_id and
its text are one document, and all are returned; different texts with one doc_id are documents of their own, the
smaller hash first; rows without doc_id are kept whole. An empty table gives an
empty result. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, mix, numbers, plain_names, schema_of, stored, text_or_empty
from tessera.operators.ranking import numbered

WINDOW, NAME = 100, 37
SPAN = WINDOW - NAME + 1
#: Windows (or bytes of text) worked on at once, and sampled suffixes held before they leave a task.
SLICE, HELD = 1 << 18, 250_000
#: Different contexts of one first name, from which its windows go by themselves; of one go of a task.
HEAVY, LOCAL = 1_000, 64
#: In place of `at`: a range that is settled, a mark of a common name, a sample of one.
SETTLED, MARK, COMMON = -1, -2, -3
BASE, SEED = np.uint64(0x9E3779B97F4A7C15 | 1), 11
LETTERS = numbers(256, SEED)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(BASE), -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 16)

#: Two prime moduli under 2**31, so that products of residues stay under 2**62, and a base for each.
PRIMES = ((2**31 - 1, 1_540_483_477), (2**31 - 19, 1_103_515_245))
RESIDUES = [LETTERS % np.uint64(p) for p, _ in PRIMES]


def _residues(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime: the powers of its base and of the base's inverse, by doubling."""
    out = []
    for p, base in PRIMES:
        both = []
        for b in (base, pow(base, -1, p)):
            x = np.ones(1, np.uint64)
            while len(x) < n:
                x = np.concatenate([x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)])
            both.append(x[:n])
        out.append((both[0], both[1]))
    return out


_PRIME_POWERS = _residues(1 << 16)


class Names:
    """Names of all substrings of a buffer, from prefix sums: one family modulo 2**64, one modulo two primes."""

    def __init__(self, data: np.ndarray):
        global _UP, _DOWN, _PRIME_POWERS
        if len(data) >= len(_UP):
            _UP, _DOWN = _powers(2 * len(data))
            _PRIME_POWERS = _residues(2 * len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * _UP[: len(data)], out=self.sums[1:])
        self.prime_sums = []
        for (p, _), letters, (up, _) in zip(PRIMES, RESIDUES, _PRIME_POWERS):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(letters[data] * up[: len(data)] % np.uint64(p), out=sums[1:])  # under 2**64 for 2**33 bytes
            self.prime_sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _DOWN[start])

    def second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of 62 bits that don't depend on those of the first family."""
        a, b = ((sums[end] - sums[start]) % np.uint64(p) * down[start] % np.uint64(p) for (p, _), sums, (_, down) in zip(PRIMES, self.prime_sums, _PRIME_POWERS))
        return mix(a << np.uint64(31) | b)


def samples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray] | None:
    """The sampled suffixes of documents in one buffer: name, whole (name of all bytes touched), doc, at, low, high.

    The sample at `at` has the windows that start at low to high; places count from the document's start.
    """
    n = len(data) - NAME + 1
    if n < SPAN:
        return None
    names = Names(data)
    first = mix((names.sums[NAME:] - names.sums[:-NAME]) * _DOWN[:n])
    least = ((first >> np.uint64(32)) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # ties: leftmost
    step = 1
    while step < SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    windows = np.maximum(ends - starts - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(starts)), windows)
    if not len(doc):
        return None
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    at = (least[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(at, prepend=-1) != 0)  # a sample's windows are adjacent
    low, high = begin[cut], begin[np.append(cut[1:], len(begin)) - 1]
    at, doc = at[cut], doc[cut]
    whole = names.second(low, high + WINDOW) ^ mix(((at - low) * 64 + (high - at + 64)).astype(np.uint64))
    base = starts[doc]
    return {"name": first[at], "whole": whole, "doc": doc, "at": at - base, "low": low - base, "high": high - base}


def _slices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row numbers, data, starts, ends, skipped) of runs of rows, for a batch whose column 1 is binary.

    A long row comes in parts of SLICE windows; `skipped` bytes of it are before the part.
    """
    col = b.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(offsets) or offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(col.buffers()[2], np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        base, size = offsets[row], int(offsets[end] - offsets[row])
        if end == row + 1 and size > SLICE + WINDOW:
            for skipped in range(0, size - WINDOW + 1, SLICE):
                part = data[base + skipped : min(offsets[end], base + skipped + SLICE + WINDOW - 1)]
                yield np.array([row]), part, np.zeros(1, np.int64), np.array([len(part)]), skipped
        else:
            yield np.arange(row, end), data[base : offsets[end]], offsets[row:end] - base, offsets[row + 1 : end + 1] - base, 0
        row = end


SAMPLE = "name long, whole long, doc_id long, at int, low int, high int"
ROWS = 50_000


def _batches(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(cols.values())))
    for at in range(0, n, ROWS):
        yield pa.record_batch([pa.array(c[at : at + ROWS]) for c in cols.values()], names=list(cols))


def _first_places(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Samples to the first of each (name, whole), and the others as few ranges of window starts."""
    order = np.lexsort((x["at"], x["doc_id"], x["whole"], x["name"]))
    x = {k: v[order] for k, v in x.items()}
    equal = np.zeros(len(order), bool)
    equal[1:] = (x["name"][1:] == x["name"][:-1]) & (x["whole"][1:] == x["whole"][:-1])
    place = np.zeros(len(order), bool)
    place[1:] = equal[1:] & (x["doc_id"][1:] == x["doc_id"][:-1]) & (x["at"][1:] == x["at"][:-1])
    first = {k: v[~equal] for k, v in x.items()}
    # a row that repeats the head's place isn't a copy of it
    head = np.maximum.accumulate(np.where(~equal, np.arange(len(order)), 0))
    copy = equal & ~((x["doc_id"] == x["doc_id"][head]) & (x["at"] == x["at"][head]))
    return first, ranges({k: x[k][copy] for k in ("doc_id", "low", "high")})


def ranges(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Join adjacent ranges of window starts."""
    if not len(x["low"]):
        return x
    order = np.lexsort((x["low"], x["doc_id"]))
    doc, low, high = (x[k][order] for k in ("doc_id", "low", "high"))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)
    cut = np.flatnonzero(new)
    return {"doc_id": doc[cut], "low": low[cut], "high": np.maximum.reduceat(high, cut)}


def _own_names(x: dict[str, np.ndarray]) -> np.ndarray:
    """Names under which rows travel that need to meet no others."""
    return mix(x["doc_id"].view(np.uint64) + x["low"].astype(np.uint64) * BASE).view(np.int64)


def _leaving(held: list[dict[str, np.ndarray]], local: int = LOCAL) -> Iterator[pa.RecordBatch]:
    """Samples to rows: the first places; settled copies; of a name with over `local` first places a mark, and they by themselves."""
    first, copies = _first_places({k: np.concatenate([h[k] for h in held]) for k in held[0]})
    held.clear()
    rows = {k: first[k].view(np.int64) for k in ("name", "whole", "doc_id")} | {k: first[k].astype(np.int32) for k in ("at", "low", "high")}
    cuts = np.flatnonzero(np.append(True, rows["name"][1:] != rows["name"][:-1]))  # sorted by name
    common = np.repeat(np.diff(np.append(cuts, len(rows["name"]))) > local, np.diff(np.append(cuts, len(rows["name"]))))
    yield from _batches({k: v[~common] for k, v in rows.items()})
    if common.any():
        marked = {k: v[common] for k, v in rows.items()}
        names = np.unique(marked["name"])
        zero = np.zeros(len(names), np.int32)
        yield from _batches({"name": names, "whole": names, "doc_id": np.zeros(len(names), np.int64), "at": zero + MARK, "low": zero, "high": zero})
        own = _own_names(marked)
        yield from _batches(marked | {"name": own, "whole": own, "at": np.full(len(own), COMMON, np.int32)})
    if n := len(copies["low"]):
        own = _own_names(copies)
        yield from _batches({"name": own, "whole": own, "doc_id": copies["doc_id"], "at": np.full(n, SETTLED, np.int32)} | {k: copies[k].astype(np.int32) for k in ("low", "high")})


def _sampled(batches: Iterator[pa.RecordBatch], local: int = LOCAL) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        ids = b.column(0).to_numpy()
        for rows, data, starts, ends, skipped in _slices(b):
            if x := samples(data, starts, ends):
                x["doc_id"] = ids[rows][x.pop("doc")]
                for k in ("at", "low", "high"):
                    x[k] = (x[k] + skipped).astype(np.int32)
                held.append(x)
                if sum(len(h["at"]) for h in held) >= HELD:
                    yield from _leaving(held, local)
    if held:
        yield from _leaving(held, local)


def _by_name(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list]:
    """Runs of rows sorted by column 0 that don't cut a group of equal values."""
    rest: list[pa.RecordBatch] = []
    held = 0

    def whole() -> list:
        t = pa.Table.from_batches(rest)
        return [t.column(i) for i in range(width)]

    for b in batches:
        if not len(b):
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held + cut >= ROWS and (cut or key[0] != rest[-1].column(0)[-1].as_py()):
            if cut:
                rest.append(b.slice(0, cut))
            yield whole()
            rest, held, b = [], 0, b.slice(cut)
        rest.append(b)
        held += len(b)
    if rest:
        yield whole()


def _settled(batches: Iterator[pa.RecordBatch], heavy: int = HEAVY) -> Iterator[pa.RecordBatch]:
    """Sorted samples to repeats (state 1), and to first places whose name has other wholes (2; 3 if over heavy or marked)."""
    for cols in _by_name(batches, 6):
        name, whole, doc, at, low, high = (c.to_numpy() for c in cols)
        head = np.ones(len(name), bool)
        head[1:] = name[1:] != name[:-1]
        new = head.copy()
        new[1:] |= whole[1:] != whole[:-1]
        group = np.cumsum(head) - 1
        several = np.bincount(group, weights=new)[group]
        common = (np.bincount(group, weights=at == MARK) > 0)[group] | (several > heavy)
        first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
        place = (doc == doc[first]) & (at == at[first])
        state = np.where(new, np.where(common, 3, np.where(several > 1, 2, 0)), np.where(place, 0, 1))
        state = np.select([at == SETTLED, at == COMMON, at == MARK], [1, 3, 0], state).astype(np.int32)
        keep = state > 0
        yield from _batches({"name": name[keep], "doc_id": doc[keep], "at": at[keep], "low": low[keep], "high": high[keep], "state": state[keep]})


CONTEXT = SAMPLE + ", context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, data, places): a row with its bytes for each unsettled sample, or one for each window by its own names."""
    kinds = pa.schema([("name", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.binary())])
    held: list[dict[str, np.ndarray]] = []

    def leave() -> Iterator[pa.RecordBatch]:
        for b in _leaving(held):
            yield pa.record_batch([*b.columns, pa.nulls(len(b), pa.binary())], schema=kinds)

    for b in batches:
        places = b.column(2)
        name, at, low, high, state = (places.flatten().field(k).to_numpy() for k in ("name", "at", "low", "high", "state"))
        counts = np.diff(places.offsets.to_numpy())
        row = np.repeat(np.arange(len(b)), counts)
        ids, texts = b.column(0).to_numpy(), b.column(1)
        easy = np.flatnonzero(state == 2)
        for s in range(0, len(easy), ROWS):
            part = easy[s : s + ROWS]
            views = {r: texts[int(r)].as_buffer() for r in np.unique(row[part])}
            context = [views[r][a:z].to_pybytes() for r, a, z in zip(row[part].tolist(), low[part].tolist(), (high[part] + WINDOW).tolist())]
            yield pa.record_batch([name[part], name[part], ids[row[part]], at[part], low[part], high[part], pa.array(context, pa.binary())], schema=kinds)
        hard = np.flatnonzero(state == 3)
        for r in np.unique(row[hard]):
            own = hard[row[hard] == r]
            gone = np.zeros(high[own].max() + 2, np.int32)
            np.add.at(gone, low[own], 1)
            np.add.at(gone, high[own] + 1, -1)
            every = np.flatnonzero(np.cumsum(gone) > 0).astype(np.int32)
            text = np.frombuffer(texts[int(r)].as_buffer(), np.uint8)
            cuts = np.searchsorted(every, np.arange(every[0], every[-1] + 1, SLICE))
            for a, z in zip(cuts, [*cuts[1:], len(every)]):
                if a == z:
                    continue
                start = every[a:z]
                at0 = int(start[0])
                names = Names(text[at0 : int(start[-1]) + WINDOW])
                key, other = (f(start - at0, start - at0 + WINDOW) for f in (names.of, names.second))
                held.append({"name": key, "whole": other, "doc_id": np.full(len(key), ids[r]), "at": start, "low": start, "high": start})
                if sum(len(h["at"]) for h in held) >= HELD:
                    yield from leave()
    if held:
        yield from leave()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by name to the windows that repeat an earlier one of the same name."""
    for name, doc, low, high, context in _by_name(batches, 5):
        name, doc, low, high = (c.to_numpy() for c in (name, doc, low, high))
        parts = [np.frombuffer(x, np.uint8) for x in context.to_pylist()]
        for s, e in _even(name, [len(p) for p in parts]):
            data = np.concatenate(parts[s:e])
            size = np.array([len(p) for p in parts[s:e]])
            n = size - WINDOW + 1
            row = np.repeat(np.arange(s, e), n)
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(np.cumsum(size) - size, n) + shift
            names = Names(data)
            key, other, start = names.of(begin, begin + WINDOW), names.second(begin, begin + WINDOW), low[row] + shift
            order = np.lexsort((start, doc[row], other, key))
            key, other, start, row = key[order], other[order], start[order], row[order]
            again = np.zeros(len(key), bool)
            again[1:] = (other[1:] == other[:-1]) & (key[1:] == key[:-1])
            again[1:] &= (doc[row[1:]] != doc[row[:-1]]) | (start[1:] != start[:-1]) | again[:-1]
            yield from _batches(ranges({"doc_id": doc[row[again]], "low": start[again].astype(np.int32), "high": start[again].astype(np.int32)}))


def _even(name: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of whole groups, of about a slice of bytes."""
    ends = np.append(np.flatnonzero(np.diff(name)) + 1, len(name))
    total, start = np.cumsum(sizes), 0
    for e in ends:
        if total[e - 1] - (total[start - 1] if start else 0) >= SLICE or e == len(name):
            yield start, int(e)
            start = int(e)


RANGE = "doc_id long, low int, high int"


def repeated_ranges(docs: DataFrame, heavy: int = HEAVY, local: int = LOCAL) -> DataFrame:
    """(doc_id, low, high): a string of WINDOW bytes that starts at low to high also starts earlier.

    heavy, local: so many different contexts of a name (in one go of a task) send its windows by themselves; the
    result is the same.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where("doc_id is not null").select("doc_id", F.encode(text_or_empty(docs), "utf-8").alias("data"))
    long = texts.where(F.length("data") >= WINDOW)
    sampled = long.mapInArrow(lambda b: _sampled(b, local), SAMPLE)
    dealt = sampled.repartition(n, "name").sortWithinPartitions("name", "whole", "doc_id", "at")
    settled = stored(dealt.mapInArrow(lambda b: _settled(b, heavy), "name long, doc_id long, at int, low int, high int, state int"), "settled")
    places = settled.where("state > 1").groupBy("doc_id").agg(F.collect_list(F.struct("name", "at", "low", "high", "state")).alias("places"))
    contexts = stored(long.join(places, "doc_id").select("doc_id", "data", "places").mapInArrow(_contexts, CONTEXT), "contexts")
    with_bytes = contexts.where("context is not null").select("name", "doc_id", "low", "high", "context")
    merged = with_bytes.repartition(n, "name").sortWithinPartitions("name").mapInArrow(_merged, RANGE)
    single = contexts.where("context is null").drop("context").repartition(n, "name").sortWithinPartitions("name", "whole", "doc_id", "at")
    single = single.mapInArrow(_settled, "name long, doc_id long, at int, low int, high int, state int").where("state = 1")
    return settled.where("state = 1").select("doc_id", "low", "high").union(merged).union(single.select("doc_id", "low", "high"))


def kept_spans(size: int, low: list[int], high: list[int]) -> list[tuple[int, int]]:
    """Of a text of `size` bytes, the runs that no window of the ranges covers."""
    out, at = [], 0
    for a, z in sorted(zip(low, high)):
        if a > at:
            out.append((at, a))
        at = max(at, min(size, z + WINDOW))
    return [*out, (at, size)] if at < size else out


def placed(docs: DataFrame) -> DataFrame:
    """Documents with place, a number for each distinct (doc_id, text) in order of doc_id: doc_id itself where that tells texts apart.

    Of different texts with one doc_id, that of the smaller hash counts as earlier.
    """
    pair = F.xxhash64(text_or_empty(docs))
    pairs = docs.where("doc_id is not null").select("doc_id", pair.alias("digest")).distinct()
    if pairs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("place", F.col("doc_id"))
    own = numbered(pairs, [F.col("doc_id"), F.col("digest")], "place").toDF("own_id", "own_digest", "place")
    joined = docs.join(own, (docs["doc_id"] == own["own_id"]) & (pair == own["own_digest"]), "left")
    return joined.select(*(docs[c] for c in docs.columns), own["place"])


def _with_ranges(docs: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents with a place, with arrays low and high of their ranges at the end."""
    found = stored(found, "ranges")
    found = found.groupBy(F.col("doc_id").alias("range_doc")).agg(F.collect_list("low").alias("range_low"), F.collect_list("high").alias("range_high"))
    joined = docs.join(found, docs["place"] == found["range_doc"], "left")
    return joined.select(*(docs[c] for c in columns), found["range_low"], found["range_high"])


def suffix_digest(docs: DataFrame, heavy: int = HEAVY, local: int = LOCAL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, low, high in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                spans = kept_spans(len(data), low or [], high or [])
                kept = b"".join(data[a:z] for a, z in spans)
                gaps = len(spans) - 1 + (not spans or spans[0][0] > 0) + (not spans or spans[-1][1] < len(data)) if data else 0
                rows.append((len(data), len(data) - len(kept), gaps if spans or not data else 1, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = placed(docs.select("doc_id", "text"))
    texts = docs.select("doc_id", "place", F.encode(text_or_empty(docs), "utf-8").alias("data"))
    rows = _with_ranges(texts, repeated_ranges(docs.select(F.col("place").alias("doc_id"), "text"), heavy, local), ["doc_id", "data"])
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages; a character goes only if all its bytes are repeats.

    The columns stay, n_chars (if there) follows the new text, and documents left without text go.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            n = b.num_columns
            for text, low, high in zip(*(b.column(i).to_pylist() for i in (0, n - 2, n - 1))):
                if text is None or not low:
                    out.append(text)
                    continue
                data = text.encode("utf-8", "surrogatepass")
                spans = []
                for a, z in kept_spans(len(data), low, high):
                    while a > 0 and data[a] & 0xC0 == 0x80:
                        a -= 1
                    while z < len(data) and data[z] & 0xC0 == 0x80:
                        z += 1
                    spans.append(data[a:z])
                out.append(b"".join(spans).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([pa.array(out, pa.string()), *b.columns[1:-2]], names=b.schema.names[:-2])

    names, docs = docs.columns, plain_names(docs, "doc_id", "text", "n_chars")
    others = [c for c in docs.columns if c != "text"]
    known = placed(docs)
    found = repeated_ranges(known.select(F.col("place").alias("doc_id"), "text"))
    out = _with_ranges(known, found, ["text", *others]).mapInArrow(work, schema_of(docs, ["text", *others]))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
    return out.where(F.col("text").isNull() | F.col("text").rlike(r"\S")).select(*docs.columns).toDF(*names)
