"""Cross-tokenizer alignment: the tokens of two vocabularies over the same bytes, and how often they go together.

A text is encoded by A (byte-level BPE, of a space and the text) and by B (pieces, which add that space). For a block of
texts at once, a cumulative sum of token lengths gives the tokens' ends as bytes of the block; ends that both have
(intersect1d) are the cuts, and searchsorted labels each token with its group. Tokens of A and B whose bytes overlap are
linked: the first and last B token that overlap an A token come from searchsorted, and a repeat-based expansion lists the
links. Each document's links are stored as its distinct id pairs with their number.

The pairs are counted over all documents in two shuffles: by pair and one of SALTS salts, so that a pair that is in every
document isn't one task's, then by pair. A document then looks up its pairs' counts; the table of counts is broadcast up
to BROADCAST_ROWS rows, and beyond both sides are shuffled from stored tables, so adaptive execution can split a hot pair.

Null and empty texts, and texts whose tokens of A or of B joined aren't a space and the text (an unknown piece, U+2581
in the text), have no tokens: zeros and ''. Very long texts are a block each and encoded whole. Rows are counted
each by itself, also repeated ones and rows without doc_id. Ties: all B ids of the highest count of an A id are best. An
empty table gives an empty result. Only doc_id and text are read, whatever the other columns' names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_letters
from tessera.llm.common import arrow_limits, stored, text_or_empty

BLOCK_CHARS, CACHE, WORD_CHARS, SALTS, BROADCAST_ROWS = 400_000, 200_000, 64, 16, 1_000_000
SPACE = "▁"


class ByteTokens:
    """A: ids of texts by a byte-level vocabulary in which no string is special; names: each id's bytes."""

    # characters on whose classes the two public libraries agree; of them the faster one encodes these
    PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞₠-₿]*")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.names = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for name, i in chain(ranks.items(), ((t.encode(), i) for t, i in special.items())):
            self.names[i] = name
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        if self.PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """B: ids of texts by a piece vocabulary. No piece goes on over the start of a word, so words are encoded each by itself; short ones are kept."""

    WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in names)
        self.names = [bytes([int(x[1:-1], 16)]) if self.library.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.space = [self.library.piece_to_id(SPACE)]  # of an empty text the library makes nothing, not its space
        self.newer: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.library.encode(texts, num_threads=1)
        words = [self.WORD.findall(SPACE + t.replace(" ", SPACE)) for t in texts]
        if len(self.newer) > CACHE:
            self.older, self.newer = self.newer, {}
        newer, older, missing = self.newer, self.older, []
        newer[SPACE] = self.space
        for w in set(chain.from_iterable(words)):
            if w not in newer:
                if w in older:
                    newer[w] = older[w]
                else:
                    missing.append(w)
        if missing:  # the library puts a space before each text; a word that begins without one never comes
            newer.update(zip(missing, self.library.encode([w[1:].replace(SPACE, " ") for w in missing], num_threads=1)))
        out = [list(chain.from_iterable(map(newer.__getitem__, w))) for w in words]
        for w in missing:
            if len(w) > WORD_CHARS:
                del newer[w]
        return out


class Aligner:
    """Both vocabularies and, for the groups' digest, each id as text with what follows it."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t.names], np.int64) for t in (self.a, self.b))
        self.base = 2 * len(self.a.names)
        self.digits = [f"{i}{end}" for names, ends in ((self.a.names, ",|"), (self.b.names, ",;")) for end in ends for i in range(len(names))]

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of each text; none where the tokens' bytes aren't a space and the text."""
        whole = [" " + t for t in texts]
        out = []
        for w, text, b in zip(whole, texts, self.b.ids(texts)):
            data = w.encode("utf-8", "surrogatepass")
            a = self.a.ids(w) if text else []
            same = text and b"".join(map(self.a.names.__getitem__, a)) == data and b"".join(map(self.b.names.__getitem__, b)) == data
            out.append((a, b) if same else ([], []))
        return out

    def block(self, texts: list[str]) -> dict[str, list]:
        """The columns of ALIGNED but row and doc_id for some texts; all arrays go over the whole block."""
        both = self.encoded(texts)
        n_a, n_b = (np.array([len(x[k]) for x in both]) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in both), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        doc_of_a, doc_of_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        a_last = np.diff(a_group, append=-1) != 0
        groups = np.bincount(doc_of_a[a_last], minlength=len(texts))
        # links: A token i overlaps B tokens first[i] to last[i]
        a_start = a_end - self.a_size[a]
        first, last = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_end, a_end)
        n = last - first + 1
        left = np.repeat(np.arange(len(a)), n)
        right = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc_of_link = doc_of_a[left]
        links = np.bincount(doc_of_link, minlength=len(texts))
        pair, times = np.unique(doc_of_link << 32 | a[left] << 16 | b[right], return_counts=True)
        # the digest's text: an A token comes after the B tokens of earlier groups, a B token after the A tokens up to its own group
        b_last = np.diff(b_group, append=-1) != 0
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + np.where(a_last, len(self.a.names), 0)
        code[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = b + self.base + np.where(b_last, len(self.b.names), 0)
        shown, at, digest = list(map(self.digits.__getitem__, code.tolist())), 0, []
        for k in (n_a + n_b).tolist():
            digest.append(hashlib.sha256("".join(shown[at : at + k])[:-1].encode()).hexdigest() if k else "")
            at += k
        starts = np.searchsorted(pair >> 32, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array((x & 0xFFFFFFFF).astype(np.int64) if k == 0 else x.astype(np.int32))) for k, x in enumerate((pair, times))]
        return {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(groups), "n_links": pa.array(links), "groups_sha256": pa.array(digest, pa.string()), "pairs": lists[0], "times": lists[1]}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """This process' aligner of the two files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ALIGNED of every text; a pair is the A id times 65,536 plus the B id, times: its links in the text."""
    arrow_limits(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            aligner = aligner_of(a_path, b_path)
            size = np.cumsum(b.column(2).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_CHARS)))
                part = b.slice(at, to - at)
                columns = aligner.block(part.column(1).to_pylist())
                yield pa.record_batch([pa.array(range(row, row + len(part)), pa.int64()), part.column(0), *columns.values()], names=["row", "doc_id", *columns])
                row, at = row + len(part), to

    text = text_or_empty(docs)
    return docs.select("doc_id", text.alias("text"), F.length(text).alias("size")).mapInArrow(work, ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, docs, best) of links (row, pair), a row for each pair of a document: how many hold it, and whether that is the most of its A id."""
    salted = links.groupBy("pair", F.pmod("row", F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("docs"))
    counts = salted.groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 16)))  # at most a row for each id of B
    return counts.select("pair", "docs", (F.col("docs") == most).alias("best"))


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text."""
    table = stored(aligned(docs, a_path, b_path), "aligned")
    links = table.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair", "times": "n"})
    counts = stored(pair_counts(links), "pairs")
    small = counts.limit(broadcast_rows + 1).count() <= broadcast_rows
    counted = links.join(F.broadcast(counts) if small else counts, "pair")
    sums = counted.groupBy(F.col("row").alias("own")).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    out = table.drop("pairs", "times").join(sums, F.col("row") == F.col("own"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def pair_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, docs, best): the aligned pairs of the corpus, with the number of documents that hold each."""
    table = stored(aligned(docs, a_path, b_path).select("row", "pairs"), "aligned")
    counts = pair_counts(table.select("row", F.explode("pairs").alias("pair")))
    return counts.select(F.shiftright("pair", 16).cast("int").alias("a_id"), (F.col("pair") % 65_536).cast("int").alias("b_id"), "docs", "best")
