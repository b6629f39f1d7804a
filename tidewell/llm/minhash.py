r"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds its distinct runs of five words ([^\x20\x09-\x0D]+, A-Z as a-z); with
fewer words, the whole sequence. Documents with equal sets are one class, named by its smallest
doc_id. Each class has COORDINATES minima. Two sets of likeness 0.75 agree on 48 of 64 in the
mean and hardly ever (six standard deviations) on fewer than MATCHES = 27; so candidates are the
pairs that agree on 27 or more.

Posting: a class is posted under its coordinate-value pairs. All classes order their 64 pairs
alike, the common ones last. A pair of classes that agree on 27 or more must share one of the
first 64 - 27 + 1 = 38 of each; the other 26 are skipped. So what a very common passage or line
gives falls out of the lists, and lists of one class are dropped when they are read.

Collisions are counted on the signatures that postings carry. First each class is linked with
the list leader that it agrees with most (a long list has a leader for each block, and block
leaders meet in a second step), and links are confirmed on the full sets: intersection * 100 >=
union * 75. That joins most of a group of copies by as many pairs as it has members. Then only
lists with classes of several components are read again, for the classes that collide often
enough with one of another component; a pair is met in the first list that both share alone, and
long lists are compared by tiles. Only these classes go on, with SKETCH coordinates of two bits,
of which a pair has to share SKETCH_MATCHES (832 of 1024 are expected at 0.75; the threshold lies
five standard deviations below).
First each tries the class of another component that it agrees with most; then every pair of
different components that still collides so often and fits in size is confirmed. So no link
between components is lost, and no group is expanded into all its pairs.

Lists are sorted by Spark, which can spill, and read by Python workers a run of rows at a time.

Defined cases: a text without words (or null) has an empty set and is its own component; rows
with a null id are not linked, have no component and are kept; repeated rows share a component;
rows with one id and different texts are one document, linked by any of them, that stays or goes
whole; very long texts count whole; an empty table gives none; other columns are ignored,
whatever their names. keep_one() drops the rows that are not kept, and all but one of the rows
that have both id and text in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, fresh, maybe_broadcast, release, table
from .graph import components
from .textops import SLICE_BYTES, distinct_per_doc, frugal, mix, shingles, slices, span_hashes, utf8, words

K = 5
COORDINATES = 64
MATCHES = 27
PREFIX = COORDINATES - MATCHES + 1
PERCENT = 75
BLOCK = 2000
TILE = 4000
SHORT = 16
SKETCH = 1024
SKETCH_MATCHES = 768
#: Rows of lists that a task holds at once (a list of a tile's size always whole).
HELD = 40_000
U = np.uint64
_FACTORS = (mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)).tolist()
_LONGER = (mix(np.arange(1, SKETCH + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)).tolist()


def sets(data: np.ndarray, offs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and where each text's begin."""
    s, e, doc = words(data, offs)
    h, d, _ = distinct_per_doc(*shingles(span_hashes(data, s, e), doc, k))
    return h, np.searchsorted(d, np.arange(len(offs)))


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COORDINATES minima of each set (0 for empty ones), and 128 bits that name the set."""
    n = len(bounds) - 1
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    sig, name = np.zeros((n, COORDINATES), U), np.zeros((n, 2), U)
    if len(full):
        at = bounds[:-1][full]
        for j, f in enumerate(_FACTORS):
            sig[full, j] = np.minimum.reduceat(mix(h * U(f)) if j == 0 else (h * U(f)) ^ ((h * U(f)) >> U(32)), at)
        name[full, 0] = np.add.reduceat(mix(h), at)
        name[full, 1] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), at)
    return sig, name


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of an array as fixed parts of one buffer."""
    x = np.ascontiguousarray(x)
    n, w = len(x), x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _rows(column, dtype, width: int) -> np.ndarray:
    data, _ = utf8(column)
    return data.view(dtype).reshape(-1, width)


def _narrow(sig: np.ndarray) -> np.ndarray:
    """The low 24 bits of each coordinate, as three bytes."""
    return np.ascontiguousarray(sig.astype("<u4")).view(np.uint8).reshape(len(sig), COORDINATES, 4)[:, :, :3].reshape(len(sig), -1)


def _wide(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), COORDINATES, 4), np.uint8)
    out[:, :, :3] = b.reshape(len(b), COORDINATES, 3)
    return out.reshape(len(b), -1).view("<u4")


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, name (of the set) and sig of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = sets(*utf8(part.column("text")))
                sig, name = signatures(h, bounds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(np.diff(bounds)), _binary(name), _binary((sig >> U(32)).astype(np.uint32))], ["doc_id", "th", "n_shingles", "name", "sig"])

    return _keyed(docs).mapInArrow(frugal(run), "doc_id long, th long, n_shingles long, name binary, sig binary")


def lows(classes: DataFrame) -> DataFrame:
    """rep, n and low, the low halves of sig."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), _binary(_rows(b.column("sig"), np.uint32, COORDINATES).astype(np.uint16))], ["rep", "n", "low"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, low binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and the compressed text of the rows that ids (doc_id, th) name."""

    def run(batches):
        for b in batches:
            texts = [x.as_buffer() for x in b.column("text").cast(pa.binary()).fill_null(b"")]
            blobs = [pa.compress(x, codec="zstd", asbytes=True) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.size for x in texts], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "size", "blob"])

    out = cut(_keyed(docs).join(maybe_broadcast(ids), ["doc_id", "th"]).select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, size long, blob binary"))
    return cut(out.distinct()) if out.count() > ids.count() else out


def unpacked(blobs, sizes) -> tuple[np.ndarray, np.ndarray]:
    texts = [bytes(pa.decompress(x, n, codec="zstd", asbytes=True)) if n else b"" for x, n in zip(blobs.to_pylist(), sizes.to_pylist(), strict=True)]
    return utf8(pa.array(texts, pa.large_binary()))


def _runs(batch: pa.RecordBatch, size: str, limit: int = SLICE_BYTES):
    """The rows of a batch in runs of about limit bytes of unpacked text."""
    at, total = 0, np.cumsum(batch.column(size).to_numpy())
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _tokens(sig: np.ndarray) -> np.ndarray:
    """The coordinate-value pairs as 64-bit numbers; the coordinate is in the last six bits."""
    at = np.arange(COORDINATES, dtype=U)
    return mix(sig.astype(U) * U(64) + at) & ~U(63) | at


def _common(classes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that about a thousandth of all classes have, and their counts: 64,000 at most.

    This only settles the common order of tokens; any order gives the same candidates."""

    def count(batches):
        held = [_tokens(_rows(b.column("sig"), np.uint32, COORDINATES)).ravel() for b in batches if b.num_rows]
        if held:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(2, len(held) and sum(map(len, held)) / COORDINATES / 2000)
            yield pa.RecordBatch.from_arrays([pa.array(t[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["t", "n"])

    rows = classes.select("sig").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, n / 1000)).collect()
    t, c = np.array([r.t for r in rows], np.int64).view(U), np.array([r.n for r in rows], np.int64)
    order = np.argsort(t)
    return t[order], c[order]


def _prefix(sig: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each class's tokens, how common each is (0: not), and its PREFIX rarest coordinates."""
    tok = _tokens(sig)
    seen = np.zeros(tok.shape, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, tok), len(often) - 1)
        seen = np.where(often[at] == tok, counts[at], 0)
    return tok, seen, np.lexsort((tok, seen), axis=1)[:, :PREFIX]


def posts(classes: DataFrame, common) -> DataFrame:
    """t, salt, blocks (whether the list is in blocks) and rep: each class under its PREFIX rarest tokens."""

    def run(batches):
        often, counts = common.value
        for b in batches:
            if not b.num_rows:
                continue
            sig = _rows(b.column("sig"), np.uint32, COORDINATES)
            tok, seen, order = _prefix(sig, often, counts)
            tok, seen = np.take_along_axis(tok, order, 1).ravel(), np.take_along_axis(seen, order, 1).ravel()
            who = np.repeat(np.arange(b.num_rows), PREFIX)
            rep = b.column("rep").to_numpy()[who]
            blocks = -(-seen // BLOCK)
            salt = np.where(blocks > 1, (mix(rep.view(U) ^ tok) % np.maximum(blocks, 1).astype(U)).astype(np.int64), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(salt), pa.array(blocks > 1), pa.array(rep)], _POST)

    return classes.mapInArrow(frugal(run), _POST_KIND)


_POST = ["t", "salt", "blocks", "rep"]
_POST_KIND = "t long, salt int, blocks boolean, rep long"


_WIDE = {"low": (np.uint16, COORDINATES), "mid": (np.uint8, 3 * COORDINATES), "more": (U, SKETCH // 32)}


def _lists(batches, key: list[str], whole: bool = False):
    """Runs of lists from rows sorted by key and class: the columns, the signatures, where each list begins, and whether the first row was given before.

    A list of over HELD rows comes in several runs, each led by the list's first row; or, with whole, in one."""
    most = HELD
    held, n, lead = [], 0, None

    def of(t: pa.Table):
        return np.stack([t.column(c).to_numpy() for c in key])

    def run(t: pa.Table):
        lent = lead is not None and bool((of(lead)[:, 0] == of(t)[:, 0]).all())
        t = pa.concat_tables([lead, t]).combine_chunks() if lent else t.combine_chunks()
        k = of(t)
        new = np.r_[True, (k[:, 1:] != k[:, :-1]).any(0)]
        cols = {c: t.column(c).to_numpy() for c in t.column_names if c not in _WIDE}
        wide = {c: _rows(t.column(c), *_WIDE[c]) for c in t.column_names if c in _WIDE}
        return cols, wide, np.flatnonzero(new), lent

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < most:
            continue
        t = pa.Table.from_batches(held)
        k = of(t)
        last = int(np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(0)])[-1])
        if last:
            yield run(t[:last])
            lead, t = None, t[last:].combine_chunks()
            held, n = t.to_batches(), t.num_rows
        elif whole:
            most = 2 * n
        else:
            yield run(t)
            lead = lead if lead is not None and bool((of(lead)[:, 0] == k[:, 0]).all()) else t[:1].combine_chunks()
            held, n = [], 0
    if held:
        yield run(pa.Table.from_batches(held))


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT


def middles(classes: DataFrame, common) -> DataFrame:
    """rep, n, mask (the prefix's coordinates as bits) and mid, 24 bits of each coordinate."""

    def run(batches):
        often, counts = common.value
        for b in batches:
            sig = _rows(b.column("sig"), np.uint32, COORDINATES)
            mask = np.bitwise_or.reduce(np.int64(1) << _prefix(sig, often, counts)[2], axis=1) if len(sig) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array(mask), _binary(_narrow(sig))], ["rep", "n", "mask", "mid"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, mask long, mid binary")


def shared_posts(posted: DataFrame) -> DataFrame:
    """Postings of the lists that hold more than one class; every block of a list in blocks stays."""

    def run(batches):
        for cols, _, first, lent in _lists(batches, ["t", "salt"]):
            size = np.diff(np.r_[first, len(cols["rep"])])
            keep = (np.repeat(size, size) > 1) | cols["blocks"].astype(bool)
            keep[0] &= not lent
            yield pa.RecordBatch.from_arrays([pa.array(cols[c][keep]) for c in _POST], _POST)

    return posted.repartition("t", "salt").sortWithinPartitions("t", "salt", "rep").mapInArrow(frugal(run), _POST_KIND)


def leaders(shared: DataFrame, low: DataFrame) -> DataFrame:
    """a, b, hits: each class with the leader of its block of each list, and block leaders with their list's.

    With t: the postings a of the list t that can still matter, which are those of lists longer than
    SHORT and, in shorter ones, classes that collide often enough with any other of the list."""

    def run(batches):
        for cols, wide, first, lent in _lists(batches, ["t", "salt"]):
            sig = wide["low"]
            size = np.diff(np.r_[first, len(sig)])
            lead = np.repeat(first, size)
            hits = (sig == sig[lead]).sum(1)
            ok = (np.arange(len(sig)) != lead) & (hits >= MATCHES) & _fits(cols["n"], cols["n"][lead])
            count = np.repeat(size, size)
            live = count > SHORT
            if lent:
                live[: size[0]] = True
            which, close = np.repeat(np.arange(len(first)), size), np.zeros(len(sig), bool)
            for d in range(1, SHORT):
                i = np.flatnonzero((which[d:] == which[:-d]) & ~live[:-d])
                i = i[_fits(cols["n"][i], cols["n"][i + d])]
                i = i[(sig[i] == sig[i + d]).sum(1) >= MATCHES]
                close[i], close[i + d] = True, True
            live = (live | close | cols["blocks"].astype(bool)) & (cols["salt"] >= 0)
            live[0] &= not lent
            none = pa.nulls(int(live.sum()), pa.int64())
            names = ["a", "b", "hits", "t"]
            yield pa.RecordBatch.from_arrays([pa.array(cols["rep"][lead][ok]), pa.array(cols["rep"][ok]), pa.array(hits[ok].astype(np.int64)), pa.nulls(int(ok.sum()), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(cols["rep"][live]), none, none, pa.array(cols["t"][live])], names)

    # The second step's members are the block leaders.
    second = shared.where("blocks").groupBy("t", "salt").agg(F.min("rep").alias("rep")).select("t", F.lit(-1).alias("salt"), F.lit(True).alias("blocks"), "rep")
    rows = shared.unionAll(second).join(low, "rep").select("t", "salt", "blocks", "rep", "n", "low")
    return rows.repartition("t", "salt").sortWithinPartitions("t", "salt", "rep").mapInArrow(frugal(run), "a long, b long, hits long, t long")


def _sketches(texts: DataFrame) -> DataFrame:
    """rep and a longer signature of two bits a coordinate."""

    def run(batches):
        for batch in batches:
            for part in _runs(batch, "size"):
                h, bounds = sets(*unpacked(part.column("blob"), part.column("size")))
                more = np.zeros((len(bounds) - 1, SKETCH), np.uint8)
                full = np.flatnonzero(bounds[1:] > bounds[:-1])
                if len(full):
                    at = bounds[:-1][full]
                    for j in range(SKETCH):
                        more[full, j] = (mix(np.minimum.reduceat(h * U(_LONGER[j]), at)) >> U(62)).astype(np.uint8)
                more = more[:, 0::4] | more[:, 1::4] << 2 | more[:, 2::4] << 4 | more[:, 3::4] << 6
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(more)], ["rep", "more"])

    return texts.mapInArrow(frugal(run), "rep long, more binary")


def mixed_lists(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """t, rep, c and tiles of the lists that hold classes of several components c."""
    known = shared.select("t", "rep").distinct().join(comp, shared.rep == comp.id, "left").select("t", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = known.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("t", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    return known.join(maybe_broadcast(cut(mixed)), "t")


def _tiled(lists: DataFrame, signed: DataFrame, *what: str) -> DataFrame:
    """The rows of lists with their signatures, sorted by list; long lists are cut into tiles, and tiles x and y meet."""
    rows = lists.join(signed, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("t", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "n", "c", "mask", "mid", *what)
    return rows.repartition("t", "x", "y").sortWithinPartitions("t", "x", "y", "rep")


def _met(batches):
    """For each list (or two tiles of one) with several components: its columns and signatures, and a function that gives the places after i of the classes that i has to be compared with.

    These are of another component (and, of two tiles, in the other), fit in size, agree on MATCHES coordinates, and
    have this list as the first that both are posted in."""
    for cols, wide, first, _ in _lists(batches, ["t", "x", "y"], whole=True):
        for a, z in zip(first, np.r_[first[1:], len(cols["rep"])], strict=True):
            c = cols["c"][a:z]
            if c.min() == c.max():
                continue
            sig, n, own, here, tiled = _wide(wide["mid"][a:z]), cols["n"][a:z], cols["own"][a:z], int(cols["t"][a]) & 63, cols["x"][a] != cols["y"][a]
            posted = (cols["mask"][a:z, None] >> np.arange(COORDINATES)) & 1 == 1

            def others(i, c=c, sig=sig, n=n, own=own, here=here, tiled=tiled, posted=posted):
                ok = (c[i + 1 :] != c[i]) & _fits(n[i + 1 :], n[i])
                if tiled:
                    ok &= own[i + 1 :] != own[i]
                on = np.flatnonzero(ok) + i + 1
                if len(on):
                    same = sig[on] == sig[i]
                    on = on[(same.sum(1) >= MATCHES) & ((same & posted[on] & posted[i]).argmax(1) == here)]
                return on

            yield {k: v[a:z] for k, v in cols.items()}, {k: v[a:z] for k, v in wide.items()}, others


def colliding(lists: DataFrame, middle: DataFrame) -> DataFrame:
    """t and rep of the classes that collide with a class of another component in the list t."""

    def run(batches):
        for cols, _, others in _met(batches):
            hit = np.zeros(len(cols["rep"]), bool)
            for i in range(len(hit) - 1):
                on = others(i)
                if len(on):
                    hit[i] = hit[on] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols["t"][hit]), pa.array(cols["rep"][hit])], ["t", "rep"])

    return _tiled(lists, middle).mapInArrow(frugal(run), "t long, rep long").distinct()


def crossing(lists: DataFrame, middle: DataFrame, sketches: DataFrame, every: bool) -> DataFrame:
    """Pairs a < b of different components that share SKETCH_MATCHES: all of them, or of each class the one that shares most."""

    def run(batches):
        for cols, wide, others in _met(batches):
            more, rep = wide["more"], cols["rep"]
            best, of = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
            for i in range(len(rep) - 1):
                on = others(i)
                if len(on):
                    off = more[on] ^ more[i]
                    hits = SKETCH - np.bitwise_count((off | off >> U(1)) & U(0x5555555555555555)).sum(1, dtype=np.int64)
                    near = hits >= SKETCH_MATCHES
                    on, hits = on[near], hits[near]
                if not len(on):
                    continue
                if every:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), rep[i])), pa.array(rep[on]), pa.array(hits)], ["a", "b", "hits"])
                else:
                    up = hits > best[on]
                    best[on[up]], of[on[up]] = hits[up], rep[i]
                    k = int(hits.argmax())
                    if hits[k] > best[i]:
                        best[i], of[i] = hits[k], rep[on[k]]
            if not every and best.any():
                k = best > 0
                yield pa.RecordBatch.from_arrays([pa.array(of[k]), pa.array(rep[k]), pa.array(best[k])], ["a", "b", "hits"])

    pairs = _tiled(lists, middle.join(sketches, "rep"), "more").mapInArrow(frugal(run), "a long, b long, hits long")
    if not every:
        pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are as alike as asked; texts holds a text of each class."""
    pairs = cut(pairs.select("a", "b"))
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct())
    own = texts.join(maybe_broadcast(ids), "doc_id")
    rows = pairs.join(own.withColumnsRenamed({"doc_id": "b", "size": "nb", "blob": "tb"}), "b").join(own.withColumnsRenamed({"doc_id": "a", "size": "na", "blob": "ta"}), "a")

    def run(batches):
        for batch in batches:
            for left in _runs(batch, "na"):
                for part in _runs(left, "nb"):
                    # A leader's text comes with many pairs; its set is made once.
                    a = part.column("a").to_numpy()
                    ids, at, of = np.unique(a, return_index=True, return_inverse=True)
                    at = pa.array(at)
                    ha, ba = sets(*unpacked(part.column("ta").take(at), part.column("na").take(at)))
                    hb, bb = sets(*unpacked(part.column("tb"), part.column("nb")))
                    ok = np.zeros(part.num_rows, bool)
                    for i, k in enumerate(of):
                        x, y = ha[ba[k] : ba[k + 1]], hb[bb[i] : bb[i + 1]]
                        both = np.isin(x, y, assume_unique=True).sum()
                        ok[i] = both * 100 >= (len(x) + len(y) - both) * PERCENT
                    keep = pa.array(ok)
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    out = cut(rows.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(frugal(run), "a long, b long"))
    drop(pairs, ids)
    return out


def linked(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id and component of every class (rep, th, n, sig) that has links."""
    spark = docs.sparkSession
    n = classes.count()
    common = spark.sparkContext.broadcast(_common(classes, n))
    posted = cut(shared_posts(posts(classes.select("rep", "sig"), common)))
    release(spark)
    texts = packed(docs, cut(posted.select("rep").distinct().join(classes, "rep").select(F.col("rep").alias("doc_id"), "th")))
    # Each class tries the leader that it agrees with most.
    led = cut(leaders(posted, lows(classes)))
    drop(posted)
    live = cut(led.where("t is not null").select("t", F.col("a").alias("rep")))
    best = led.where("t is null").groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a"))
    comp = cut(components(confirmed(best, texts)))
    drop(led)
    del posted, led, best
    release(spark)
    # Components only grow, so no other classes can be missing from later steps.
    middle = middles(classes, common)
    mixed = cut(mixed_lists(live, comp))
    shared = cut(colliding(mixed, middle))
    drop(live, mixed)
    del live, mixed
    release(spark)
    own = cut(shared.select(F.col("rep").alias("doc_id")).distinct())
    sketches = cut(_sketches(texts.join(maybe_broadcast(own), "doc_id")))
    for every in (False, True):
        mixed = cut(mixed_lists(shared, comp))
        more = confirmed(crossing(mixed, middle, sketches, every), texts)
        if not more.isEmpty():
            comp = cut(components(comp.select(F.col("component").alias("a"), F.col("id").alias("b")).unionAll(more)))
        drop(mixed, more)
        release(spark)
    drop(texts, sketches, shared)
    return comp


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id and kept of every row."""
    described = cut(describe(docs))
    classes = described.where("n_shingles > 0 and doc_id is not null").groupBy("name").agg(F.min(F.struct("doc_id", "th")).alias("x"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.select("name", F.col("x.doc_id").alias("rep"), "x.th", "n", "sig"))
    whole, described = described, cut(described.drop("sig"))
    drop(whole)
    del whole
    comp = linked(classes.select("rep", "th", "n", "sig"), docs)
    # A document of several texts links their classes.
    several = described.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x <> y")
    several = cut(described.join(several, "doc_id", "left_semi").join(classes, "name").select("doc_id", "rep").distinct())
    if not several.isEmpty():
        edges = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
        comp = cut(components(edges.unionAll(comp.select(F.col("component").alias("a"), F.col("id").alias("b")))))
    named = classes.join(comp, classes.rep == comp.id, "left").select("name", F.coalesce("component", "rep").alias("component_id"))
    rows = described.join(named, "name", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "th", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _judged(docs).drop("th")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component, the document with the smallest id, repeated rows once."""
    names = docs.columns
    i, t, n = fresh(docs, "the_id", "the_hash", "the_number")
    rows = cut(_judged(docs).where("doc_id is not null").groupBy("doc_id", "th").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64("text")})
    on = rows.select(F.col("doc_id").alias(i), F.col("th").alias(t), F.when(F.col("kept"), F.col("n")).otherwise(0).alias(n))
    known = keyed.join(maybe_broadcast(on), [i, t], "left")
    # Few rows are repeated; only they are shuffled.
    return known.where(F.col(n).isNull()).select(*names).unionAll(known.where(F.col(n) > 1).dropDuplicates([i, t]).select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
