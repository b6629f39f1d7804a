"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of LENGTH = 50 bytes over it also starts in a document with a smaller
doc_id. Suffixes that agree in their first 50 bytes are neighbours in suffix order, so each
group of such neighbours tells the smallest document of its string.

Whole corpora are cut into blocks that hold all suffixes with a given content. Each string of
50 bytes is named by the smallest hash of its runs of GRAM = 16 bytes; equal strings have equal
names. Neighbouring strings with one name and place form a stretch, from the first one's start
to the last one's end.

1. Texts are packed into chunks; a text longer than a chunk comes in pieces that overlap by
   LENGTH - 1 bytes, so each string lies in one. Each chunk sends the distinct names of its strings,
   in BUCKETS groups by name, with the number of distinct stretches that each has; a name is
   answered as repeated if two documents have it. Strings with another name occur in one document
   and are out.
2. A name with over HOT distinct stretches (a short common line with ever new surroundings) would
   fill a block alone. Its strings get names of their own, the hashes of their 50 bytes, which a
   chunk, holding just these stretches, sends and gets answered in the same way; so strings that
   occur once are out, and equal ones are one stretch a chunk.
3. Each chunk sends its distinct stretches with repeated names, each once with the smallest
   document that has it, to the block of the name; so a passage that a third of all
   documents hold arrives once a chunk.
4. Each block takes its names in parts of about SORT_BYTES of text. It joins a part's distinct
   stretches (but those alone with their name, which can agree with no other) to one text and sorts
   its suffixes a bucket at a time (suffix.py): by their first 64 bytes, and what is still equal by
   the precomputed ranks of suffixes at difference-cover positions. Memory is bounded by a block's
   stretches and answers, and a part's ranks and one bucket. It answers each stretch with the smallest document of each string.
5. Chunks turn answers into spans of bytes, and documents are cut.

Defined cases: null text counts as empty; matches never cross documents; a null doc_id counts
as larger than all others; rows with one doc_id are one document to each other (neither is
smaller) but are cut alike by smaller ones; texts of any length count whole; an empty table gives
none; other columns are carried by removed() and ignored by digests(), whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, fresh, maybe_broadcast, release, table
from .suffix import octets, shares, sorted_buckets
from .textops import frugal, mix, slices, span_hashes, utf8

LENGTH = 50
GRAM = 16
CHUNK_BYTES = 1 << 20
#: Text of a bucket, at most. A chunk has a row a bucket, so rows grow with chunks times buckets: few, large
#: buckets keep them in proportion to the text. Blocks sort a bucket in parts of SORT_BYTES.
BLOCK_BYTES = 32 << 20
SORT_BYTES = 1 << 20
#: Distinct stretches of one name beyond which its strings get names of their own.
HOT = 20_000
LEAST_BUCKETS = 256
LAST = (1 << 63) - 1
U = np.uint64


def _pack(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True) if x.nbytes else b""


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype) if b else np.zeros(0, dtype)


def stretches(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, first byte, number of strings and text of each stretch. Names have 58 bits."""
    n = len(data)
    m, w = n - length + 1, length - gram + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none.view(U), none, none, none
    o = octets(data)
    k = n - gram + 1
    h = mix(o[:k] * U(0x9E3779B97F4A7C15) + mix(o[gram - 8 : gram - 8 + k] * U(0xC2B2AE3D27D4EB4F)))
    for j in range(8, gram - 8, 8):
        h = mix(h + o[j : j + k])
    h &= ~U(63)
    h |= np.arange(k, dtype=U) & U(63)  # the place, to tell minima apart
    low, size = h, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:m], low[w - size : w - size + m])
    inside = np.zeros(n + 1, np.int8)
    # A string that begins in the last length - 1 bytes of a text would cross it.
    for a in offs[1:]:
        inside[max(0, a - length + 1) : a] = 1
    ok = inside[:m] == 0
    edge = np.ones(m + 1, bool)
    edge[1:m] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
    at = np.flatnonzero(edge[:m])
    count = np.diff(np.r_[at, m])
    good = ok[at]
    at, count = at[good], count[good]
    # Minima are small numbers; scrambled, they fall evenly into buckets.
    return mix(low[at] >> U(6)) >> U(6), at, count, np.searchsorted(offs, at, "right") - 1


def _hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the byte spans, as rows."""
    a = span_hashes(data, at, at + size, fold=False)
    return np.stack([a, mix(a ^ span_hashes(data, at + (size >> 1), at + size, fold=False) * U(3))], 1)


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans, joined."""
    total = int(size.sum())
    where = np.repeat(at - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
    return data[where]


def chunks(docs: DataFrame) -> DataFrame:
    """chunk and the packed ids, text hashes, first bytes' places, offsets and texts of runs of rows of about CHUNK_BYTES, or of a piece of one text."""

    def run(batches):
        task, i = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def row(ids, th, base, offs, data):
            nonlocal i
            i += 1
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | i]), pa.array([len(data)], pa.int64()), *(pa.array([_pack(x)], pa.binary()) for x in (ids, th, base, offs, data))], _CHUNK)

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            data, offs = utf8(t.column("text"))
            return row(t.column("id").to_numpy(), t.column("th").to_numpy(), np.zeros(t.num_rows, np.int64), offs, data)

        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES // 4):
                data, offs = utf8(part.column("text"))
                if part.num_rows == 1 and len(data) > CHUNK_BYTES:
                    for a in range(0, len(data) - LENGTH + 1, CHUNK_BYTES - LENGTH + 1):
                        piece = data[a : a + CHUNK_BYTES]
                        yield row(part.column("id").to_numpy(), part.column("th").to_numpy(), np.array([a]), np.array([0, len(piece)]), piece)
                    continue
                held.append(part)
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(frugal(run), "chunk long, size long, ids binary, th binary, base binary, offs binary, data binary")


_CHUNK = ["chunk", "size", "ids", "th", "base", "offs", "data"]


def _buckets(total: int) -> int:
    """Number of buckets (a power of 2) for so many bytes of text."""
    return max(LEAST_BUCKETS, 1 << (max(1, -(-total // BLOCK_BYTES)) - 1).bit_length())


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (names >> U(58 - (buckets.bit_length() - 1))).astype(np.int64)


def _split(x: np.ndarray, buckets: int):
    """Bucket and bounds of the runs of ascending names x that lie in one bucket."""
    if not len(x):
        return []
    group = _bucket(x, buckets)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return [(int(group[a]), a, z) for a, z in zip(first, [*first[1:], len(x)], strict=True)]


def _chosen(got: list, x: np.ndarray, what: str, buckets: int) -> np.ndarray:
    """The answered bits for the ascending names x."""
    by = {g["bucket"]: g[what] for g in got}
    bits = [np.unpackbits(np.frombuffer(by[g], np.uint8), count=z - a) if by[g] else np.zeros(z - a, np.uint8) for g, a, z in _split(x, buckets)]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def _singles(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all strings of the stretches, and each one's stretch."""
    of = np.repeat(np.arange(len(at)), count)
    return at[of] + np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count), of


def _names(rows: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, names (ascending, 5 bytes each), which of them two of the chunk's documents have, and how many distinct stretches each has.

    Rows are chunks, or what chunks have kept of hot names (with places), whose strings are named one by one."""
    hot = "places" in rows.columns
    data_ = "text" if hot else "data"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                c, ids, offs, data = (b.column(x)[i].as_py() for x in ("chunk", "ids", "offs", data_))
                data, offs, ids = _unpack(data, np.uint8), _unpack(offs, np.int64), _unpack(ids, np.int64)
                if hot:
                    name, at, count, doc = _hot(data, b.column("places")[i].as_py())[:4]
                else:
                    name, at, count, doc = stretches(data, offs)
                name, several, many = _of_chunk(data, name, at, count, doc, ids)
                found = [(c, g, name[a:z].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.packbits(several[a:z]).tobytes(), _pack(many[a:z])) for g, a, z in _split(name, buckets)]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols[:2]] + [pa.array(x, pa.binary()) for x in cols[2:]], ["chunk", "bucket", "names", "several", "many"])

    return rows.select("chunk", "ids", "offs", data_, *["places"] * hot).mapInArrow(frugal(run), "chunk long, bucket long, names binary, several binary, many binary")


def _hot(data: np.ndarray, places: bytes):
    """Names, places in data, counts (1), texts and places in the chunk of the strings of hot names; data holds their stretches."""
    at, count, doc = _unpack(places, np.int32).astype(np.int64).reshape(3, -1)
    begin = np.r_[0, np.cumsum(count + LENGTH - 1)[:-1]]
    here, of = _singles(begin, count)
    there, _ = _singles(at, count)
    return span_hashes(data, here, here + LENGTH, fold=False) >> U(6), here, np.ones(len(here), np.int64), doc[of], there


def _of_chunk(data, name, at, count, doc, ids):
    """The chunk's distinct names in ascending order, whether two of its documents have each, and its distinct stretches."""
    who = ids[doc]
    size = count + LENGTH - 1
    h = span_hashes(data, at, at + size, fold=False)
    order = np.lexsort((h, name))
    name, who, h = name[order], who[order], h[order]
    new = name[1:] != name[:-1]
    first = np.flatnonzero(np.r_[True, new]) if len(name) else np.zeros(0, np.int64)
    if not len(first):
        return name, np.zeros(0, bool), np.zeros(0, np.uint16)
    several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
    many = np.add.reduceat(np.r_[True, new | (h[1:] != h[:-1])].astype(np.int64), first)
    return name[first], several, np.minimum(many, 65535).astype(np.uint16)


def _repeated(named: DataFrame, hot: int) -> DataFrame:
    """chunk, bucket, a bit for each of the chunk's names in the bucket: whether two documents have it, and one whether it has over hot stretches (empty: none has)."""

    def run(key, t):
        names = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in t.column("names").to_pylist()]
        own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(t.column("several").to_pylist(), names, strict=True)]
        many = np.concatenate([_unpack(x, np.uint16) for x in t.column("many").to_pylist()])
        bounds = np.r_[0, np.cumsum([len(n) for n in names])]
        wide = np.zeros((bounds[-1], 8), np.uint8)
        wide[:, :5] = np.concatenate(names)
        flat = wide.view(np.int64).ravel()
        order = np.argsort(flat, kind="stable")
        x = flat[order]
        same = np.zeros(len(x) + 1, bool)
        same[1:-1] = x[1:] == x[:-1]
        first = np.flatnonzero(~same[:-1])
        load = np.add.reduceat(many[order].astype(np.int64), first) > hot
        hit, much = np.empty(len(x), bool), np.zeros(len(x), bool)
        hit[order] = same[1:] | same[:-1]
        hit |= np.concatenate(own)
        if load.any():
            much[order] = np.repeat(load, np.diff(np.r_[first, len(x)]))
        each = list(zip(bounds[:-1], bounds[1:], strict=True))
        bits = [np.packbits(hit[a:z]).tobytes() for a, z in each]
        over = [np.packbits(much[a:z]).tobytes() if much[a:z].any() else b"" for a, z in each]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(over, pa.binary())})

    return named.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, bits binary, hot binary")


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias(name))


def _sent(rows: DataFrame, buckets: int) -> DataFrame:
    """What chunks send on: a row for each bucket with distinct stretches (text, sizes, smallest document), one with their places (bucket -1), and one with the stretches of hot names (bucket -2).

    Rows are chunks with answers in got, or what chunks have kept of hot names (with places), which count as chunks of their own."""
    hot = "places" in rows.columns
    data_ = "text" if hot else "data"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                c, ids, th, base, offs, data, got = (b.column(x)[i].as_py() for x in ("chunk", "ids", "th", "base", "offs", data_, "got"))
                about = [ids, th, base, offs]
                data, ids = _unpack(data, np.uint8), _unpack(ids, np.int64)
                if hot:
                    name, at, count, doc, place = _hot(data, b.column("places")[i].as_py())
                else:
                    name, at, count, doc = stretches(data, _unpack(offs, np.int64))
                    place = at
                known = np.unique(name)
                which = np.searchsorted(known, name)
                keep = _chosen(got, known, "bits", buckets)[which]
                if not hot:
                    much = _chosen(got, known, "hot", buckets)[which]
                    keep &= ~much
                    if much.any():
                        a, n = at[much], count[much]
                        yield _one(c, -2, [b"", _pack(_gather(data, a, n + LENGTH - 1)), *about, _pack(np.stack([a, n, doc[much]]).astype(np.int32))])
                name, at, count, doc, place = (x[keep] for x in (name, at, count, doc, place))
                if not len(name):
                    continue
                size = count + LENGTH - 1
                h = _hashes(data, at, size)
                # Distinct stretches, ordered by name and so by bucket.
                order = np.lexsort((ids[doc], h[:, 1], h[:, 0], name))
                x, y = h[order], name[order]
                new = np.r_[True, (x[1:] != x[:-1]).any(1) | (y[1:] != y[:-1])]
                which = np.empty(len(order), np.int64)
                which[order] = np.cumsum(new) - 1
                one = order[new]  # the smallest document's
                del h, x, y, order, new
                own = c | _KEPT if hot else c
                yield _one(own, -1, [b"", b"", *about, _pack(np.stack([place, count, doc, which]).astype(np.int32))])
                out = []
                for g, a, z in _split(name[one], buckets):
                    mine = one[a:z]
                    out.append((own, g, _pack(name[mine].astype(np.uint32)), _pack(_gather(data, at[mine], size[mine])), _pack(ids[doc[mine]]), b"", b"", b"", _pack(size[mine].astype(np.int32))))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[2:])], _SENT)

    return rows.select("chunk", "ids", "th", "base", "offs", data_, "got", *["places"] * hot).mapInArrow(frugal(run), "chunk long, bucket long, " + ", ".join(f"{x} binary" for x in _SENT[2:]))


_SENT = ["chunk", "bucket", "names", "text", "ids", "th", "base", "offs", "sizes"]
#: Marks the number of what a chunk has kept of hot names.
_KEPT = 1 << 62


def _one(chunk: int, bucket: int, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], _SENT)


def smallest(text: np.ndarray, size: np.ndarray, least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string of the stretches (joined in text), the smallest document that has it, in order."""
    if not len(size):
        return np.zeros(0, np.int64)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    count = size - length + 1
    of = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + begin[of]
    place = np.full(len(text), -1, np.int64)
    place[start] = np.arange(len(start))
    out = np.empty(len(start), np.int64)
    o = octets(text)

    def settle(run: np.ndarray) -> None:
        if not len(run):
            return
        i = place[run]
        new = np.r_[True, ~shares(o, run[:-1], run[1:], length)]
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(least[of[i]], first)
        out[i] = low[np.cumsum(new) - 1]

    for bucket in sorted_buckets(text, start):
        # Bucket bounds are whole first words, so no group of equal strings is cut.
        settle(bucket)
    return out


def _of_part(data: np.ndarray, size: np.ndarray, name: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each string of the distinct stretches, and where each stretch's first one stands there."""
    at = np.r_[0, np.cumsum(size)[:-1]]
    # Equal stretches of several chunks are one.
    h = _hashes(data, at, size)
    order = np.lexsort((least, h[:, 1], h[:, 0]))
    x = h[order]
    new = np.r_[True, (x[1:] != x[:-1]).any(1)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    count = size[one] - LENGTH + 1
    begin = np.r_[0, np.cumsum(count)[:-1]]
    # A name's only stretch has no other to agree with; its strings are its own. (32 bits of names may meet by chance.)
    _, of, several = np.unique(name[one], return_inverse=True, return_counts=True)
    sort = several[of] > 1
    found = np.repeat(least[one], count)
    found[np.repeat(sort, count)] = smallest(_gather(data, at[one][sort], size[one][sort]), size[one][sort], least[one][sort])
    return begin[which], found


def _answered(sent: DataFrame) -> DataFrame:
    """chunk, bucket and the smallest document of every string of every stretch that the chunk sent."""

    def run(key, t):
        size, name, least = ([_unpack(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("sizes", np.int32), ("names", np.uint32), ("ids", np.int64)))
        bounds = np.r_[0, np.cumsum([len(x) for x in size])]
        size, name, least = np.concatenate(size).astype(np.int64), np.concatenate(name), np.concatenate(least)
        data, count = np.empty(size.sum(), np.uint8), size - LENGTH + 1
        a = 0
        for x in t.column("text"):
            x = _unpack(x.as_py(), np.uint8)
            data[a : a + len(x)] = x
            a += len(x)
        at = np.r_[0, np.cumsum(size)[:-1]]
        parts = -(-len(data) // SORT_BYTES)
        # Equal strings have equal names, so they are in one part.
        part = (name.astype(U) * U(parts) >> U(32)).astype(np.int64)
        begin, found, total = np.empty(len(size), np.int64), [], 0
        for p in range(parts):
            own = np.flatnonzero(part == p)
            if len(own):
                here, answers = _of_part(_gather(data, at[own], size[own]), size[own], name[own], least[own])
                begin[own] = here + total
                found.append(answers)
                total += len(answers)
        found = np.concatenate(found)
        out = [_pack(_gather(found, begin[a:z], count[a:z])) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "least": pa.array(out, pa.binary())})

    return sent.where("bucket >= 0").groupBy("bucket").applyInArrow(run, "chunk long, bucket long, least binary")


def _spans_of(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that strings of length at the ascending places at cover."""
    new = np.r_[True, at[1:] > at[:-1] + length]
    last = np.r_[new[1:], True]
    return at[new], at[last] + length


def spans(docs: DataFrame) -> DataFrame:
    """id, th (hash of the text) and the removed runs' starts and ends, as pairs of 32-bit numbers, of the rows that lose any."""
    spark = docs.sparkSession
    packed = cut(chunks(docs))
    total = packed.agg(F.sum("size")).head()[0] or 0
    buckets = _buckets(total)
    answers = cut(_repeated(_names(packed, buckets), HOT))
    release(spark)
    sent = cut(_sent(packed.join(_gathered(answers, "got"), "chunk"), buckets))
    drop(packed, answers)
    # The strings of hot names are named and answered a second time.
    kept = sent.where("bucket = -2").select("chunk", "ids", "th", "base", "offs", "text", F.col("sizes").alias("places"))
    own = cut(_repeated(_names(kept, buckets), 1 << 62))
    more = cut(_sent(kept.join(_gathered(own, "got"), "chunk"), buckets))
    drop(own)
    del packed, answers, own, kept
    release(spark)
    every = sent.unionAll(more)
    got = cut(_answered(every))
    release(spark)
    found = got.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "least")).alias("got"))
    rows = every.where("bucket = -1").join(found, "chunk").select("ids", "th", "base", "offs", "sizes", "got")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, th, base, offs = (_unpack(b.column(x)[i].as_py(), np.int64) for x in ("ids", "th", "base", "offs"))
                at, count, doc, which = _unpack(b.column("sizes")[i].as_py(), np.int32).astype(np.int64).reshape(4, -1)
                least = np.concatenate([_unpack(x["least"], np.int64) for x in sorted(b.column("got")[i].as_py(), key=lambda x: x["bucket"])])
                each = np.zeros(which.max() + 1, np.int64)
                each[which] = count
                begin = np.r_[0, np.cumsum(each)[:-1]]
                own = _gather(least, begin[which], count)
                start = np.repeat(at - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(own))
                d = np.repeat(doc, count)
                hit = own < ids[d]
                start, d = start[hit], d[hit]
                order = np.argsort(start, kind="stable")
                start, d = start[order], d[order]
                bounds = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True]) if len(d) else np.zeros(1, np.int64)
                out = []
                for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                    k = d[a]
                    s, e = _spans_of(start[a:z] - offs[k], LENGTH)
                    out.append((int(ids[k]), int(th[k]), int(base[k]), (np.stack([s, e], 1) + base[k]).astype(np.int32).tobytes()))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.binary())], ["id", "th", "base", "spans"])

    pieces = rows.mapInArrow(frugal(run), "id long, th long, base long, spans binary").groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("base", "spans"))).alias("p"))
    out = cut(pieces.select("id", "th", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["spans"])).alias("spans")))
    drop(sent, more, got)
    del sent, more, every, got, found, rows, pieces
    release(spark)
    return out


def _with_spans(docs: DataFrame, name: str) -> DataFrame:
    """docs with the removed runs in a further column."""
    i, t = fresh(docs, "the_id", "the_hash")
    found = spans(docs).withColumnsRenamed({"id": i, "th": t, "spans": name})
    rows = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), t: F.xxhash64("text")})
    return rows.join(maybe_broadcast(found), [i, t], "left").select(*docs.columns, name)


def _kept(text: bytes, found: bytes | None) -> tuple[bytes, int, int]:
    """What is left, and the number of removed bytes and runs. Runs that chunks have found apart may touch or overlap."""
    if not found:
        return text, 0, 0
    s, e = np.frombuffer(found, np.int32).reshape(-1, 2).T
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.r_[True, s[1:] > e[:-1]]
    s, e = s[new].tolist(), e[np.r_[new[1:], True]].tolist()
    return b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)], strict=True)), sum(e) - sum(s), len(s)


def removed(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes; where a cut leaves part of a character, it goes too."""
    names = docs.columns
    (found,) = fresh(docs, "the_spans")

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            new = [t if f is None or t is None else _kept(t, f)[0].decode("utf-8", "ignore").encode() for t, f in zip(texts, b.column(found).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()).cast(pa.string()) if n == "text" else b.column(n) for n in names], names)

    return _with_spans(docs, found).mapInArrow(frugal(run), docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches):
        for b in batches:
            rows = []
            for t, f in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("the_spans").to_pylist(), strict=True):
                left, n, k = _kept(t or b"", f)
                rows.append((len(t or b""), n, k, hashlib.sha256(left).hexdigest()))
            if rows:
                n, r, k, h = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(h)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs.select("doc_id", "text"), "the_spans").mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
