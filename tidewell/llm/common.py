"""What the operators share: the folder all executors see, lineage cuts, sized broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A joined side up to this many bytes (measured, never guessed) is broadcast.
BROADCAST_BYTES = 32 << 20
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give Python workers this library, once a context; Spark serves the archive to every executor, also to later ones."""
    sc = spark.sparkContext
    # Texts can be long: batches to Python are bounded in bytes, not in rows alone.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(sc, "_tidewell_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="tidewell-code-"), "tidewell_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._tidewell_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set only where the cluster names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidewell-")  # one process holds driver and executors
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, until drop()."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(*frames: DataFrame) -> None:
    """Delete the files of tables that cut() has made and nothing reads any more."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
            delete(df.sparkSession, plan.rdd().getCheckpointFile().get())


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files that nothing refers to any more; it works while we wait."""
    pause = 0.0 if spark.sparkContext.master.startswith("local[") else 1.0
    for _ in range(2):  # the first collection frees what holds the references that the second finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its measured size is small; else left to a shuffle join, whose skew AQE splits.

    df should be cheap to read again (a cut table)."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 24) if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes)
    if any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes):
        return df
    size = df.agg(F.sum(width)).head()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has (Spark doesn't tell upper from lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem in taken:
            stem = "_" + stem
        taken.add(stem)
        out.append(stem)
    return out


def crc_fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is the held-out fold (a null id counts as 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file on this machine."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)
