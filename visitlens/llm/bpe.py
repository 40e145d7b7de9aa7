"""BPE encoding and decoding with a word-end vocabulary.

``Codec`` reads a tokenizer file (vocabulary, ranked merges, special tokens) and encodes as that file
says: special tokens are cut out of the raw text, the rest is NFC-normalised and lower-cased, split
into words, digits and symbol runs, and each piece is merged on its byte symbols. ``merge`` keeps the
adjacent pairs of a piece in a heap by merge rank over a doubly linked list of symbols; a popped entry
whose symbols have since changed is stale and skipped. Decoding joins vocabulary strings.

Spark deals the documents to tasks; a worker loads the vocabulary once and remembers the ids of words and of
the pieces of words that it has met, up to a fixed number of each: when one is full, its older half goes.

Defined results: null and empty texts, and texts of white space only, have no tokens and decode to the
empty text; repeated rows give repeated results; whole texts are encoded whatever their length; an
empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash. Code
points newer than Unicode 15.1 follow the installed Unicode tables, which may class them otherwise than
the tokenizer's.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from visitlens.llm.common import read, small_batches

VOCABULARY = "word_bpe_49k.json"
#: Words and pieces whose ids a worker remembers, and the longest of them.
CACHED_WORDS, CACHED_PIECES, CACHED_LENGTH = 200_000, 300_000, 48
WORD_END = "</w>"
#: White space as the tokenizer's own pattern language has it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
#: The vocabulary's splitting pattern (fixed values), with its white space spelt out.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
NOT_SPACE = re.compile(f"[^{SPACE}]+")
#: Characters that str.split takes for white space and the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Codec(dict):
    """Encoder and decoder; as a mapping, from a white-space-delimited word to its ids in bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.vocab = dict(vocab)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + WORD_END] for s in symbols]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges):
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.strings = pa.array([strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)], pa.large_binary())
        self.pieces: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges, lowest rank first and leftmost among equals."""
        n = len(ids)
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two has been merged away
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heappush(heap, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((ids[h], new))):
                heappush(heap, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, merged."""
        data = piece.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        found = np.array(self.merge(ids), "<u4").tobytes()
        _remember(self.pieces, piece, found, CACHED_PIECES)
        return found

    def __missing__(self, word: str) -> bytes:
        plain = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        known = self.pieces
        found = b"".join([known.get(p) or self.piece(p) for p in (ASCII_PIECE if plain.isascii() else PIECE).findall(plain)])
        _remember(self, word, found, CACHED_WORDS)
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
            else:
                found = NOT_SPACE.findall(part) if SEPARATORS.search(part) else part.split()
                out.extend(map(self.__getitem__, found))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary strings of ``ids`` in UTF-8, joined by a space as for a file without a decoder."""
        if not ids:
            return b""
        joined = self.strings.take(pa.array(np.frombuffer(ids, "<u4")))  # every string with its space behind it
        return joined.buffers()[2].to_pybytes()[:-1]


def _remember(cache: dict, key: str, value: bytes, most: int) -> None:
    if len(key) <= CACHED_LENGTH:
        if len(cache) >= most:
            for old in list(islice(cache, len(cache) // 2)):
                del cache[old]
        cache[key] = value


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(docs: DataFrame, path: str, row, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [row(c, x.as_py()) for x in batch.column(1)]
            columns = [batch.column(0), *(zip(*out, strict=True) if out else [()] * (len(arrow) - 1))]
            yield pa.record_batch([pa.array(x, f.type) if k else x.cast(f.type) for k, (x, f) in enumerate(zip(columns, arrow, strict=True))], schema=arrow)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def _ids(c: Codec, text: str | None):
    return (np.frombuffer(c.encode(text), "<u4").astype(np.int32),)


def _digests(c: Codec, text: str | None):
    ids = c.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _mapped(docs, path or default_path(), _ids, "doc_id bigint, ids array<int>", schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give null."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, "<u4").tobytes()).decode() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(docs, path or default_path(), _digests,
                   "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", schema)


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As ``digests``, with the ids themselves."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(c: Codec, text: str | None):
        ids = c.encode(text)
        return np.frombuffer(ids, "<u4").astype(np.int32), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _mapped(docs, path or default_path(), row,
                   "doc_id bigint, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string", schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's ids and decoded text."""
    return digests(read(spark, sf_dir, "documents"))
