"""What the two text classifiers share: bounded samples of labelled rows, fixed by a hash of the id, and a fit in one task.

The sample's texts are turned into features where they are read. One task gets the features, in
the order of the classes and the ids' hashes, and fits; the driver sees the finished model alone.
The task holds ENTRIES features of each class at most: rows beyond them are not in the sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold
from .textops import frugal, slices, utf8

ENTRIES = 8_000_000
HELD_OUT = 2


def learnable(df: DataFrame) -> DataFrame:
    """Rows outside the held-out fold."""
    return df.where(crc_fold() != HELD_OUT)


def first_ids(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """doc_id and h: the distinct ids with the smallest seeded hashes, most at most. On many ids, all but the smallest hashes go first."""
    ids = ids.where("doc_id is not null").select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).distinct()
    n = ids.count()
    if n > 8 * most:
        ids = ids.where(F.col("h") < F.lit(-(1 << 63) + int((1 << 64) * 4 * most / n)))
    return ids.orderBy("h", "doc_id").limit(most)


def fitted(docs: DataFrame, chosen: DataFrame, featurize, fit, values: bool):
    """What fit makes, in one task, of the rows of chosen (doc_id, y, h; a stated number at most).

    featurize gives numbers, texts and (with values) values of a slice of texts; fit gets for each
    row y and its arrays, and returns a list of arrays. With no rows: None."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f, d, *v = featurize(*utf8(part.column("text")))
                bounds = np.searchsorted(d, np.arange(part.num_rows + 1))
                packed = [pa.array([x[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x in ([f.astype(np.uint32), v[0].astype(np.float32)] if values else [f.astype(np.uint32)] * 2)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("y", "h", "doc_id", "th")), packed[0], packed[1] if values else pa.array([b""] * part.num_rows, pa.binary())], ["y", "h", "doc_id", "th", "f", "v"])

    def learn(batches):
        ys, fs, vs, held = [], [], [], {}
        for b in batches:
            for y, f, v in zip(*(b.column(c).to_pylist() for c in ("y", "f", "v")), strict=True):
                held[y] = held.get(y, 0) + len(f) // 4
                if held[y] <= ENTRIES or y not in ys:
                    ys.append(y)
                    fs.append(np.frombuffer(f, np.uint32))
                    vs.append(np.frombuffer(v, np.float32))
        if ys:
            out = [np.ascontiguousarray(x) for x in fit(np.array(ys), fs, vs)]
            yield pa.RecordBatch.from_arrays([pa.array([str(x.dtype) for x in out]), pa.array([x.tobytes() for x in out], pa.binary())], ["kind", "data"])

    rows = texts.select("y", "h", "doc_id", "th", "text").mapInArrow(frugal(describe), "y int, h long, doc_id long, th long, f binary, v binary")
    model = rows.repartition(1).sortWithinPartitions("y", "h", "doc_id", "th").mapInArrow(frugal(learn), "kind string, data binary").collect()
    return [np.frombuffer(bytes(r.data), r.kind) for r in model] or None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def scored(docs: DataFrame, score_batch, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted; score_batch gives one number for each text of a slice."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = np.clip(score_batch(*utf8(part.column("text"))), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", (crc_fold() == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, score double, predicted int")
