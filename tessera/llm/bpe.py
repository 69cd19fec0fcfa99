"""BPE encoding and decoding with a contiguous rank array for each short word.

The vocabulary file of a public tokenizer gives the merges; nothing is trained here. A text is cut at the
special tokens' strings, normalised (NFC, white space to one space, lower case), cut into words by the file's
pattern, and each word's UTF-8 bytes are its parts. A word holds two arrays side by side, the part boundaries
and the rank of each adjacent pair; the smallest rank is found by a scan, the boundary between its parts is
deleted, and the ranks left and right of it are worked out anew, until no pair has a rank.

Words of over SHORT bytes (a scan for each merge would be quadratic) take their smallest ranks from a heap.
A worker process keeps one codec a file, with the encodings of the last CACHE to 2 * CACHE words that it met; so
tasks don't start cold, and memory doesn't grow with the corpus.

Text whose characters are all below U+0250 or in common punctuation is normalised here; any other text by the
library's normaliser and pre-tokeniser, so that rare scripts follow its Unicode tables.

Null texts count as empty: no ids and an empty decoded text. Equal texts get equal rows, an empty table gives
an empty one, and only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, given_first, schema_of, text_or_empty

SHORT, CACHE = 64, 200_000
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies use for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordEncoder:
    """Encodes single words to ids. ranks: (left part, right part) to the merge's number."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.vocabulary, self.word_end = vocabulary, word_end
        self.ranks = {pair: n for n, pair in enumerate(merges)}

    def parts(self, letters: str) -> list[str]:
        """The word's parts after all merges."""
        n = len(letters)
        if n > SHORT:
            return self._long(letters)
        ranks, end = self.ranks, self.word_end
        word = [*letters[:-1], letters[-1] + end]
        bound = list(range(n + 1))  # part i goes from bound[i] to bound[i + 1]
        rank = [ranks.get(pair, NONE) for pair in zip(word, word[1:])]
        joined = lambda a, b: letters[a:b] + (end if b == n else "")
        while rank:
            least = min(rank)
            if least == NONE:
                break
            i = rank.index(least)
            del bound[i + 1], rank[i]
            own = joined(bound[i], bound[i + 1])
            if i:
                rank[i - 1] = ranks.get((joined(bound[i - 1], bound[i]), own), NONE)
            if i < len(rank):
                rank[i] = ranks.get((own, joined(bound[i + 1], bound[i + 2])), NONE)
        return [joined(a, b) for a, b in zip(bound, bound[1:])]

    def _long(self, letters: str) -> list[str]:
        n = len(letters)
        part = [*letters[:-1], letters[-1] + self.word_end]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, str, str]] = []

        def see(i: int) -> None:
            j = after[i]
            if j < n and (r := self.ranks.get((part[i], part[j]))) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n - 1):
            see(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                see(before[i])
            see(i)
        return [p for p in part if p]

    def ids(self, parts: list[str]) -> list[int]:
        return [self.vocabulary[p] for p in parts]


class Codec:
    """Encodes and decodes whole texts like the tokenizer file that it is made from."""

    # characters whose case, class and composition need no library
    PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞₠-₿]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = WordEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.special_ids = special
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.digits = list(map(str, range(max(self.names) + 1)))

    def _encoded(self, word: str) -> tuple[int, ...]:
        """The ids of a normalised word that isn't in the newer half of the cache."""
        found = self.older.get(word)
        if found is None:
            parts = self.words.parts("".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))))
            found = tuple(self.words.ids(parts))
        if len(self.cache) >= CACHE:
            self.older = self.cache
            self.cache = {}
        self.cache[word] = found
        return found

    def normalised_words(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text) and "İ" not in text:
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        text = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.letters)}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(back[c] for c in p).decode("utf-8", "surrogatepass") for p, _ in pieces]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        ids: list[int] = []
        at = 0
        cuts = [(m.start(), m.end()) for m in self.special.finditer(text)]
        for start, end in [*cuts, (len(text), len(text))]:
            for word in self.normalised_words(text[at:start]):
                ids += self.cache.get(word) or self._encoded(word)
            if end > start:
                ids.append(self.special_ids[text[start:end]])
            at = end
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: a file without a decoder leaves them so. Unknown ids are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join(self.names[i] for i in ids if i in self.names)


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """This process' codec of the file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text; path: the vocabulary file, on every machine."""
    arrow_limits(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = codec.encode(text)
                rows.append((len(ids), digest(" ".join(map(codec.digits.__getitem__, ids))), digest(codec.decode(ids))))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty(docs).alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(table: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The table with a column ids (array of int): the text's token ids; null texts give null."""
    arrow_limits(table.sparkSession)
    kept = table.drop("ids") if text != "ids" else table
    names, plain = kept.columns, given_first(kept, text)
    others = [c for c in plain.columns if c != "given"]
    schema = f"{schema_of(plain, ['given', *others])}, ids array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            ids = [None if t is None else codec.encode(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return plain.select("given", *others).mapInArrow(work, schema).select(*plain.columns, "ids").toDF(*names, "ids")


def decode_column(table: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The table with a column decoded: the text that the ids give; null ids give null."""
    arrow_limits(table.sparkSession)
    kept = table.drop("decoded") if ids != "decoded" else table
    names, plain = kept.columns, given_first(kept, ids)
    others = [c for c in plain.columns if c != "given"]
    schema = f"{schema_of(plain, ['given', *others])}, decoded string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            out = [None if x is None else codec.decode(x) for x in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return plain.select("given", *others).mapInArrow(work, schema).select(*plain.columns, "decoded").toDF(*names, "decoded")
