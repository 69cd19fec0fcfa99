"""Lexical retrieval packing: a sharded BM25 inverted index fills each window with a seed's unused neighbours.

Each text becomes token ids (16 bits each) and an end id. Tasks also count in how many documents each id
occurs; summed over all of them this is one number for each entry of the vocabulary, the only thing broadcast.
Documents are sorted by their KEYS rarest ids (the highest: a vocabulary lists ids by falling frequency), dealt by
ranges of that order, and each task cuts its range into shards of about SHARD_TOKENS: so documents that share rare
tokens meet in a shard, whatever the size of the corpus, and equal ones spread over as many tasks as they need.
A shard's inverted index holds all terms of its documents with their BM25 weights by the corpus' document counts.
The first unused document opens a window, the index returns its unused neighbours by score, and they fill the
window in that order; a document that is too long is cut and goes on as the seed of the next window. Without
neighbours left, the next unused document follows. A window that a shard leaves open goes on in the task's next one,
so only the last sequence of a task has padding.

A piece is (doc_id, start, length) of a document, and lies at offset in sequence_id. A sequence shorter than
WINDOW is padded to it unless its length is a power of two.

Null texts count as empty and make one piece with only the end id; very long texts fill many windows. Repeated rows
are packed each by itself, ties go by the order of rows. Rows with a null doc_id are packed too. An empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_letters
from tessera.llm.common import arrow_limits, stored, text_or_empty

WINDOW, END_ID = 2_048, 1
SHARD_TOKENS, KEYS = 250_000, 4
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids like the tokenizers file's; common characters by the faster of two public libraries that agree on them."""

    PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞₠-₿]*")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()

    def ids(self, text: str) -> list[int]:
        if self.PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This process' encoder of the file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


TOKENS = "doc_id long, n_tokens long, ids binary, rare binary, row long, is_count boolean"


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """TOKENS: ids as 16-bit integers, rare to sort by, row another number for each; a task's last row holds its document counts."""
    arrow_limits(docs.sparkSession)
    names = [x.split()[0] for x in TOKENS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first = None, TaskContext.get().partitionId() << 40
        for b in batches:
            if counts is None:
                encoder = encoder_of(path)
                assert encoder.size <= 1 << 16
                counts = np.zeros(encoder.size, np.int32)
            sizes, ids, rare = [], [], []
            for text in b.column(1).to_pylist():
                x = np.array([*encoder.ids(text), END_ID], np.uint16)
                terms = np.unique(x)
                counts[terms] += 1
                sizes.append(len(x))
                ids.append(x.tobytes())
                rare.append((0xFFFF - terms[: -KEYS - 1 : -1]).astype(">u2").tobytes())
            row = np.arange(first, first + len(b))
            first += len(b)
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.binary()), pa.array(row), pa.array([False] * len(b))], names=names)
        if counts is not None:
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([counts.astype("<i4").tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([True])], names=names)

    return docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(work, TOKENS)


def _vocabulary_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            own = np.frombuffer(x, "<i4").astype(np.int64)
            total = own if total is None else total + own
    if total is not None:
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "docs"])


class Shard:
    """The inverted index of one shard: all terms of its documents with their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(docs)
        both = [np.unique(ids, return_counts=True) for ids in docs]
        self.query = [terms for terms, _ in both]
        sizes = np.array([len(terms) for terms in self.query])
        term, tf = np.concatenate(self.query), np.concatenate([k for _, k in both])
        length = np.repeat(np.array([len(ids) for ids in docs]), sizes)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = np.repeat(np.arange(self.n), sizes)[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of each document for the seed's terms."""
        terms = self.query[seed].astype(np.int64)
        start, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, by score, then by their order."""
        score = self.scores(seed)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


Piece = tuple[int, int, int, int, int]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int, sequence: int = 0, filled: int = 0) -> Generator[Piece, None, tuple[int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard; returns where the next shard goes on."""
    index = Shard(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    at = [0] * len(docs)
    sizes = [len(d) for d in docs]
    next_seed, going_on = 0, -1
    while True:
        if going_on < 0:
            while next_seed < len(docs) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return sequence, filled
            going_on = next_seed
        seed, unused[going_on] = going_on, False
        queue = iter(())
        asked, doc = False, seed
        while True:
            take = min(window - filled, sizes[doc] - at[doc])
            if take:
                yield doc, at[doc], take, sequence, filled
            at[doc] += take
            filled += take
            going_on = doc if at[doc] < sizes[doc] else -1
            if filled == window:
                sequence, filled = sequence + 1, 0
                break
            if not asked:
                queue, asked = iter(index.neighbours(seed, unused).tolist()), True
            doc = next(queue, -1)
            if doc < 0:  # the next unused document goes on in this window
                going_on = -1
                break
            unused[doc] = False


def packed(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """PIECE rows that hold each token of each document once."""
    spark = docs.sparkSession
    tokens = stored(token_table(docs, path), "tokens")
    counts = tokens.where("is_count").select("ids").mapInArrow(_vocabulary_counts, "term int, docs long")
    counts = counts.groupBy("term").agg(F.sum("docs").alias("docs")).toPandas()  # at most one row an entry of the vocabulary
    n, total = tokens.where("not is_count").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    df = np.zeros(1 << 16, np.float64)
    df[counts["term"].to_numpy(np.int64)] = counts["docs"].to_numpy(np.float64)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, total / max(n, 1))
    ranges = max(1, min(math.ceil(total / shard_tokens), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shared = spark.sparkContext.broadcast(idf)
    names = [x.split()[0] for x in PIECE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        place = (first, 0)
        own: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal place
            rows, pieces = [], pack_shard(ids, shared.value, mean, window, *place)
            while True:
                try:
                    d, start, length, sequence, offset = next(pieces)
                except StopIteration as end:
                    place = end.value
                    break
                crc = zlib.crc32(ids[d][start : start + length].astype("<u4"))
                rows.append((own[d], start, length, crc, len(ids[d]), sequence, offset))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own.append(doc_id)
                ids.append(np.frombuffer(x, np.uint16))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield from done()
                    own, ids, held = [], [], 0
        if ids:
            yield from done()

    rows = tokens.where("not is_count").select("doc_id", "ids", "rare", "row")
    dealt = rows.repartitionByRange(ranges, "rare", "row").sortWithinPartitions("rare", "row")
    return dealt.select("doc_id", "ids").mapInArrow(work, PIECE)


def padded_length(length: int, window: int = WINDOW) -> int:
    """The length that a sequence is padded to."""
    return length if length & (length - 1) == 0 else window
