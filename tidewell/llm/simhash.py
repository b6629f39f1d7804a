"""Document fingerprints by SimHash, and all pairs within a Hamming radius by permuted block tables.

Terms are the runs of three words of a text ([^\\x20\\x09-\\x0D]+, A-Z as a-z; a shorter text is
one term), each with the weight 1 + ln(count). A term's hash votes with its weight on each of
BITS signed bits; the signs of the sums are the fingerprint, in hexadecimal. The likeness of two
fingerprints is max(0, cos(pi h / BITS)), h their Hamming distance: the cosine they estimate.

near_pairs and near_counts: fingerprints are cut into blocks; two within the radius r agree on at
least blocks - r of them, so one table for each choice of that many blocks, keyed by the chosen
blocks brought to the front, holds every such pair in one of its groups, and only the first of
the tables that hold a pair reports it. Equal fingerprints are one class with its members
counted apart; a group too large for one comparison is cut into tiles, and tiles meet pairwise.
near_pairs gives the pairs of classes; near_counts, which the query uses with RADIUS, adds up the
members of the classes that each one meets, so no pair leaves its task.

Successors (query): rows in order of doc_id (null first; of repeated ids in order of the text's
hash) are cut into parts by bytes, after one look at ids, hashes and sizes; the first row of each
part is lent to the part before (of the first part to the last), so every row finds the one
after it. One shuffle of the text; parts are sorted by Spark, which can spill, and read a batch
at a time. A part's first key, 16 bytes for PART_BYTES of text, is all that tasks are sent.

Defined cases: null text counts as empty; a text without words has the fingerprint 0; two
empty ones are alike by 1; texts of any length count whole; repeated rows follow one another;
a single document is its own successor; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, table
from .textops import distinct_per_doc, frugal, mix, shingles, slices, span_hashes, utf8, words

BITS = 128
RUN = 3
PART_BYTES = 64 << 20
RADIUS = 3
#: Votes that differ by less are a tie (they are sums of logarithms, in any order), and its bit is 0.
TIE = 1e-9
TILE = 2000
U = np.uint64
#: _SIGNS[v, j]: the vote of bit j of the byte v.
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1).astype(np.float64)


def fingerprints(texts: list[str | None], bits: int = BITS, run: int = RUN) -> np.ndarray:
    """One row of bits / 8 bytes for each text."""
    out = np.zeros((len(texts), bits // 8), np.uint8)
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= 1 << 20 or i + 1 == len(texts):
            out[first : i + 1] = _fingerprints(*utf8(pa.array([x or "" for x in texts[first : i + 1]], pa.large_string())), bits, run)
            first, size = i + 1, 0
    return out


def _fingerprints(data: np.ndarray, offs: np.ndarray, bits: int, run: int) -> np.ndarray:
    n, width = len(offs) - 1, bits // 8
    s, e, doc = words(data, offs)
    h, d, count = distinct_per_doc(*shingles(span_hashes(data, s, e), doc, run))
    weight = 1.0 + np.log(np.maximum(count, 1))
    more = [h] + [mix(h + U(0x9E3779B97F4A7C15) * U(j)) for j in range(1, -(-width // 8))]
    octets = np.stack(more, 1).view(np.uint8).reshape(len(h), -1)[:, :width] if len(h) else np.zeros((0, width), np.uint8)
    out = np.zeros((n, width), np.uint8)
    bounds = np.searchsorted(d, np.arange(n + 1))
    base = np.arange(width) * 256
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if a < b:
            votes = np.bincount((octets[a:b] + base).ravel(), np.repeat(weight[a:b], width), width * 256).reshape(width, 256) @ _SIGNS
            out[i] = np.packbits(votes > TIE, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.where(h == 0, 1.0, np.maximum(0.0, np.cos(np.pi * h / (a.shape[1] * 8))))


def hexes(f: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in f]


def fingerprint(docs: DataFrame, bits: int = BITS, run: int = RUN) -> DataFrame:
    """doc_id and the fingerprint of each text."""

    def one(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hexes(fingerprints(batch.column("text").to_pylist(), bits, run)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(frugal(one), "doc_id long, fingerprint string")


def _binary(column) -> np.ndarray:
    """Fixed parts of a binary column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    width = -(-bits // parts)
    return [(j * width, min(bits, (j + 1) * width)) for j in range(parts)]


def _near(classes: DataFrame, radius: int, bits: int, blocks: int | None, tile: int, compare, schema: str) -> DataFrame:
    """compare(t, one's rows, others' rows, distances) over all pairs of classes (f, n) within the radius, each pair once."""
    cuts = _blocks(bits, blocks or radius + 1)
    chosen = list(combinations(range(len(cuts)), len(cuts) - radius))

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                f = _binary(batch.column("f"))
                b = np.unpackbits(f, axis=1)
                for t, own in enumerate(chosen):
                    keys = np.packbits(b[:, np.concatenate([np.arange(*cuts[j]) for j in own])], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), *(batch.column(c) for c in ("f", "n"))], ["t", "k", "f", "n"])

    def run(batches):
        for own in _groups(batches, ["t", "k", "lo", "hi"]):
            f = _binary(own.column("f"))
            if len(f) < 2:
                continue
            f = np.pad(f, ((0, 0), (0, -f.shape[1] % 8))).view(U)
            t, lo, hi = (own.column(c)[0].as_py() for c in ("t", "lo", "hi"))
            tile_of = own.column("own").to_numpy()
            found = []
            for i in range(len(f) - 1):
                off = f[i + 1 :] ^ f[i]
                far = np.bitwise_count(off).sum(1, dtype=np.int64)
                ok = far <= radius
                if lo != hi:
                    ok &= tile_of[i + 1 :] != tile_of[i]
                j = np.flatnonzero(ok)
                if len(j):
                    # The pair counts in the first of the tables that hold it.
                    b = np.unpackbits(np.ascontiguousarray(off[j]).view(np.uint8), axis=1)
                    differ = np.stack([b[:, a:z].any(1) for a, z in cuts], 1)
                    j = j[np.stack([~differ[:, list(c)].any(1) for c in chosen], 1).argmax(1) == t]
                    found.append((np.full(len(j), i), j + i + 1, far[j]))
            if found:
                yield from compare(own, *(np.concatenate(x) for x in zip(*found, strict=True)))

    posts = classes.mapInArrow(frugal(post), "t int, k binary, f binary, n long")
    sizes = posts.groupBy("t", "k").agg(F.count("*").alias("size")).where("size > 1")
    # A key that one class has meets nothing; only long groups are cut into tiles.
    met = posts.join(maybe_broadcast(cut(sizes)), ["t", "k"]).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("f"), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("t", "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "f", "n")
    keys = ["t", "k", "lo", "hi"]
    return met.repartition(*keys).sortWithinPartitions(*keys, "f").mapInArrow(frugal(run), schema)


def _groups(batches, key: list[str]):
    """The groups of rows sorted by key, each as one table."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        ranks = [pa.compute.dictionary_encode(t.column(c).combine_chunks()).indices.to_numpy() for c in key]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for r in ranks:
            new[1:] |= r[1:] != r[:-1]
        first = np.flatnonzero(new)
        for a, z in zip(first[:-1], first[1:], strict=True):
            yield t.slice(a, z - a)
        held = t.slice(first[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _classes(prints: DataFrame) -> tuple[DataFrame, int]:
    """The distinct fingerprints f as bytes with their number n of rows, and their bits."""
    classes = cut(prints.where("fingerprint is not null").groupBy(F.unhex("fingerprint").alias("f")).agg(F.count("*").alias("n")))
    head = classes.head()
    return classes, len(head.f) * 8 if head else BITS


def near_pairs(prints: DataFrame, radius: int, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """All pairs a < b of distinct fingerprints with at most radius differing bits: a, b, distance.

    Members of a class are the rows of prints with its fingerprint."""
    classes, bits = _classes(prints)

    def pairs(own, i, j, far):
        f = [x.hex() for x in own.column("f").to_pylist()]
        ab = [sorted((f[x], f[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ab], pa.string()), pa.array([x[1] for x in ab], pa.string()), pa.array(far.astype(np.int32))], ["a", "b", "distance"])

    return _near(classes, radius, bits, blocks, tile, pairs, "a string, b string, distance int")


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """fingerprint and n_near, the number of rows of prints within the radius of one of its rows (itself left out)."""
    classes, bits = _classes(prints)

    def sums(own, i, j, far):
        n = own.column("n").to_numpy()
        total = np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([own.column("f").take(pa.array(on)).combine_chunks(), pa.array(total[on].astype(np.int64))], ["f", "n"])

    others = _near(classes, radius, bits, blocks, tile, sums, "f binary, n long").unionAll(classes.where("n > 1").select("f", F.col("n") - 1))
    return others.groupBy("f").agg(F.sum("n").alias("n_near")).select(F.lower(F.hex("f")).alias("fingerprint"), "n_near")


_KEY = np.dtype([("low", np.int64), ("th", np.int64)])


def successors(docs: DataFrame, run, schema: str, part_bytes: int | None = None) -> DataFrame:
    """run(ids, texts, following) on runs of docs in order; following is the text after the run's last one."""
    spark = docs.sparkSession
    low, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")
    keys = docs.select(low.alias("low"), th.alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    # As many parts as fill the tasks of a shuffle evenly, of part_bytes at most.
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = part_bytes or min(PART_BYTES, max(1, -(-(keys.agg(F.sum("size")).head()[0] or 0) // n)))

    def begin(batches):
        size, last = most, None
        for b in batches:
            at, t, s = (b.column(c).to_numpy() for c in ("low", "th", "size"))
            out = []
            for k, n in zip(zip(at.tolist(), t.tolist(), strict=True), s.tolist(), strict=True):
                if size >= most and k != last:
                    out.append(k)
                    size = 0
                size += n
                last = k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64())], ["low", "th"])

    found = keys.repartitionByRange("low", "th").sortWithinPartitions("low", "th").mapInArrow(begin, "low long, th long").collect()
    cuts = np.array(sorted((r.low, r.th) for r in found), _KEY)
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("array<int>")
    def places(low: pd.Series, th: pd.Series) -> pd.Series:
        """A row's part; for the rows of a part's first key, also the one before as -1 - part (the first part follows the last)."""
        k = np.empty(len(low), _KEY)
        k["low"], k["th"] = low, th
        cuts = shared.value
        part = np.searchsorted(cuts, k, "right") - 1
        begins = cuts[part] == k
        before = (part - 1) % len(cuts)
        return pd.Series([[p, -1 - q] if x else [p] for p, q, x in zip(part.tolist(), before.tolist(), begins.tolist(), strict=True)])

    rows = docs.select(low.alias("low"), F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.explode(places("low", "th")))
    rows = rows.select(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("p"), (F.col("at") < 0).alias("lent"), "low", "th", "doc_id", "text")

    def one(batches):
        part, kept = None, None  # the row that waits for its successor
        for batch in batches:
            for b in slices(batch, "text"):
                p, lent = b.column("p").to_numpy(), b.column("lent").to_numpy(zero_copy_only=False)
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                bounds = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if p[a] != part:
                        part, kept = p[a], None
                    end = a + int(np.argmax(lent[a:z])) if lent[a:z].any() else z
                    own, words_ = ids[a:end], texts[a:end]
                    if kept is not None:
                        own, words_ = [kept[0], *own], [kept[1], *words_]
                        kept = None
                    if not own:  # further lent rows
                        continue
                    if end < z:
                        yield from run(own, words_, texts[end]).to_batches()
                    else:
                        kept = (own[-1], words_[-1])
                        if len(own) > 1:
                            yield from run(own[:-1], words_[:-1], words_[-1]).to_batches()

    return rows.repartition("p").sortWithinPartitions("p", "lent", "low", "th").mapInArrow(frugal(one), schema)


def edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, its edited text's, and their likenesses to it and the next one's."""

    def run(ids, texts, following):
        after = [*texts[1:], following]
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, after, strict=True)]
        f = fingerprints([*texts, following])
        g = fingerprints(edited)
        own = f[:-1]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array(hexes(own), pa.string()),
                "edited_fingerprint": pa.array(hexes(g), pa.string()),
                "near_edited": pa.array(likeness(own, g), pa.float64()),
                "near_next": pa.array(likeness(own, f[1:]), pa.float64()),
            }
        )

    return successors(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def with_near(edited: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of edits() with n_near, the number of other rows whose fingerprints lie within the radius."""
    edited = cut(edited)
    near = cut(near_counts(edited.select("fingerprint"), radius))
    return edited.join(maybe_broadcast(near), "fingerprint", "left").select(*edited.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near(edits(table(spark, sf_dir, "documents")))
