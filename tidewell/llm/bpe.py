"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus of a replay is the set of distinct pretokens of a run of texts. An inverted index
holds, for every merge that is possible now, the positions of its pairs in all words; merges
are replayed in rank order, each over all its positions at once, and only the pairs left and
right of a merged one enter the index anew. Where a merge opens one of lower rank in the same
word, that word's later positions wait until the lower rank has been replayed, so each word
takes its merges in the order of the standard greedy encoder. A pretoken that is itself a
token is that token.

Defined cases: null text counts as empty and gives no tokens; texts of any length are encoded
whole, special tokens' strings as ordinary text; repeated rows give repeated results; an empty
table gives none; encode(), decode() and encoded() carry all other columns, and give their own
another name, with underscores before it, where a column of the table has it. Memory: the words kept from earlier texts are dropped beyond KEPT_WORDS (about
110 MB), and texts are taken in slices, so a task holds one slice and that many words.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, table, tokenizer_path
from .textops import frugal, slices

RANKS = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 500_000
KEPT_PAIRS = 500_000
CORPUS_BYTES = 2 << 20


class Codec:
    """Encodes and decodes whole texts by the ranks in a file of base64 tokens and numbers."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.tokens}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.bytes_rank = np.array([[self.ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        #: word -> its ids in decimal
        self.kept: dict[str, str] = {}
        self.of_decimal = {str(r): t for r, t in self.tokens.items()}

    def pair(self, key: int) -> int:
        """The rank of merging the tokens a and b of the key a << 17 | b, or -1; kept in pairs."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        r = self.pairs[key] = self.ranks.get(self.tokens[key >> 17] + self.tokens[key & 0x1FFFF], -1)
        return r

    def replay(self, corpus: list[bytes]) -> list[str]:
        """The token ids of every word of the corpus, in decimal."""
        sizes = np.array([len(x) for x in corpus], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(corpus), np.uint8)
        n = len(raw)
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        word = np.repeat(np.arange(len(corpus)), sizes).tolist()
        at = np.arange(n)
        nxt = np.where(edge[1:], -1, at + 1).tolist()
        edge[0] = True
        prv = np.where(edge[:-1], -1, at - 1).tolist()
        tok = self.single[raw].tolist()
        # The index: the positions of every rank that two bytes have.
        first = self.bytes_rank[raw[:-1], raw[1:]] if n > 1 else np.zeros(0, np.int32)
        posts = np.flatnonzero((first >= 0) & ~edge[1:n])
        posts = posts[np.argsort(first[posts], kind="stable")]
        found, starts = np.unique(first[posts], return_index=True)
        index = {r: p.tolist() for r, p in zip(found.tolist(), np.split(posts, starts[1:]), strict=False)}
        ranks = found.tolist()
        known, pair = self.pairs.get, self.pair
        while ranks:
            r = heappop(ranks)
            waits: set[int] | None = None
            high = r << 17
            for p in sorted(index.pop(r)):
                n = nxt[p]
                t = tok[p]
                if n < 0 or t < 0:
                    continue
                key = t << 17 | tok[n]
                x = known(key)
                if (pair(key) if x is None else x) != r:
                    continue  # a neighbour has been merged since
                if waits and word[p] in waits:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heappush(ranks, r)
                    continue
                tok[p] = r
                tok[n] = -1
                after = nxt[p] = nxt[n]
                if after >= 0:
                    prv[after] = p
                    key = high | tok[after]
                    x = known(key)
                    if x is None:
                        x = pair(key)
                    if x >= 0:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            heappush(ranks, x)
                        if x < r:
                            waits = waits or set()
                            waits.add(word[p])
                before = prv[p]
                if before >= 0:
                    key = tok[before] << 17 | r
                    x = known(key)
                    if x is None:
                        x = pair(key)
                    if x >= 0:
                        if x in index:
                            index[x].append(before)
                        else:
                            index[x] = [before]
                            heappush(ranks, x)
                        if x < r:
                            waits = waits or set()
                            waits.add(word[p])
        left = np.array(tok, np.int64)
        alive = left >= 0
        bounds = np.r_[0, np.cumsum(alive)][np.r_[0, ends]].tolist()
        left = list(map(self.decimal.__getitem__, left[alive].tolist()))
        return [" ".join(left[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def pieces(self, texts: list[str | None]) -> list[str]:
        """The ids of each text in decimal, joined by spaces; the texts' new words are one corpus."""
        split = [self.split(t) if t else [] for t in texts]
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        new = list(set().union(*split).difference(kept))
        ranks, decimal = self.ranks, self.decimal
        longer, raw = [], []
        for w in new:
            b = w.encode()
            if (r := ranks.get(b)) is None:
                longer.append(w)
                raw.append(b)
            else:
                kept[w] = decimal[r]
        kept.update(zip(longer, self.replay(raw), strict=True))
        at = kept.__getitem__
        return [" ".join(map(at, words)) for words in split]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(map(int, found.split())) for found in self.pieces(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_decimal(self, ids: list[str]) -> bytes:
        return b"".join(map(self.of_decimal.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _named(docs: DataFrame, taken: str, *new: str) -> tuple[list[T.StructField], list[str]]:
    """The fields of docs but the one taken, and names for new ones that none of them has."""
    rest = docs.drop(taken)
    return rest.schema.fields, fresh(rest, *new)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of each text in place of the text."""
    path = path or tokenizer_path(RANKS)
    fields, (ids,) = _named(docs, text, ids)
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, text, CORPUS_BYTES):
                found = pa.array(c.encode(part.column(text).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), found], schema.names)

    return docs.mapInArrow(frugal(run), schema)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the UTF-8 text of each list of ids in place of the ids (bytes that are no UTF-8 are replaced)."""
    path = path or tokenizer_path(RANKS)
    fields, (text,) = _named(docs, ids, text)
    schema = T.StructType([*fields, T.StructField(text, T.StringType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in batches:
            found = pa.array([c.decode(x or []).decode("utf-8", "replace") for x in part.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), found], schema.names)

    return docs.mapInArrow(frugal(run), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text decoded from them."""
    path = path or tokenizer_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, "text", CORPUS_BYTES):
                rows = []
                for found in c.pieces(part.column("text").to_pylist()):
                    ids = found.split()
                    rows.append((len(ids), sha(found.encode()).hexdigest(), sha(c.decode_decimal(ids)).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids and the hash of the bytes that the ids decode to in place of the text."""
    path = path or tokenizer_path(RANKS)
    fields, new = _named(docs, "text", "n_tokens", "ids", "decoded_sha256")
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.StringType())
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text", CORPUS_BYTES):
                text = [found.split() for found in c.pieces(part.column("text").to_pylist())]
                ids = [np.array(x, np.int32) if x else np.zeros(0, np.int32) for x in text]
                sizes = np.array([len(x) for x in ids])
                found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids)))
                hashes = [hashlib.sha256(c.decode_decimal(x)).hexdigest() for x in text]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sizes, pa.int64()), found, pa.array(hashes)], schema.names)
        # Other stages' tasks share the worker; they get its memory back.
        del c
        codec.cache_clear()

    return docs.mapInArrow(frugal(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
