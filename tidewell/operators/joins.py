"""Time-bounded, ASOF, temporal and lookup joins.

None is a range join: each is an equi-join or one sort by key, so a shuffle on the keys is all
that moves. Rows with a null key or null time match nothing; outer joins keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .changelog import diff


def _right_names(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> dict[str, str]:
    return {c: f"{prefix}{c}" for c in right.columns if c in left.columns and c not in keys}


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ms: str, right_ms: str, before: int, after: int | None = None, how: str = "inner", prefix: str = "right_", buckets: bool = False) -> DataFrame:
    """Rows with equal keys and left_ms - before <= right_ms <= left_ms + after (after = before by default, both inclusive).

    With buckets (inner and left joins), time buckets of the bound join the keys, so one hot key
    spreads over tasks; a left join adds the rows that have met nothing in any of their buckets."""
    after = before if after is None else after
    names = _right_names(left, right, keys, prefix)
    r = right.withColumnsRenamed(names).withColumnsRenamed({k: f"__r_{k}" for k in keys})
    rt = names.get(right_ms, right_ms)
    near = (F.col(rt) >= F.col(left_ms) - before) & (F.col(rt) <= F.col(left_ms) + after)
    on = near
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    if buckets and how == "left":
        # A row meets the right side in several buckets; the one it lies in keeps it if none of them gives a match.
        row = F.struct(*(F.col(c) for c in left.columns))
        inner = interval_join(left.withColumn("__row", F.md5(F.to_json(row))), right, keys, left_ms, right_ms, before, after, "inner", prefix, True)
        rest = left.withColumn("__row", F.md5(F.to_json(row))).join(inner.select("__row").distinct(), "__row", "left_anti").drop("__row")
        return inner.drop("__row").unionByName(rest, allowMissingColumns=True)
    if buckets and how == "inner":
        width = max(1, before + after)
        lo, hi = F.floor((F.col(left_ms) - before) / width), F.floor((F.col(left_ms) + after) / width)
        left = left.withColumn("__b", F.explode(F.sequence(lo, hi)))
        r = r.withColumn("__rb", F.floor(F.col(rt) / width))
        on = on & (F.col("__b") == F.col("__rb"))
    out = left.join(r, on, how)
    if how in ("right", "full", "outer", "full_outer", "right_outer"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(F.col(k), F.col(f"__r_{k}")))
    return out.drop("__b", "__rb", *(f"__r_{k}" for k in keys))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ms: str, right_ms: str, direction: str = "backward", tolerance: int | None = None, how: str = "left", left_order: str | None = None, right_order: str | None = None, suffix: str = "_right", bucket_ms: int | None = None) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time.

    backward: the latest at or before, of equal times the last (by right_order); forward: the
    earliest at or after, of equal times the first; nearest: the nearer of both, backward on a tie.
    A distance above the tolerance is no match. One sort of both sides by key and time; with
    bucket_ms, by key and time bucket, so that a hot key spreads over tasks: what a bucket takes over
    from the buckets before and after comes from a table of one row a bucket."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction: {direction}")
    cols = [c for c in right.columns if c not in keys]
    lid = F.struct(*(F.col(c) for c in left.columns))
    rid = F.struct(*(F.col(c) for c in cols))
    zero = F.lit(0).cast("long")
    seq_l = F.col(left_order).cast("long") if left_order else zero
    seq_r = F.col(right_order).cast("long") if right_order else zero
    none_l, none_r = F.lit(None).cast(left.select(lid.alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(rid.alias("x")).schema["x"].dataType)
    kcols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    both = left.select(*kcols, F.col(left_ms).cast("long").alias("__t"), F.lit(1).alias("__side"), seq_l.alias("__seq"), lid.alias("__l"), none_r.alias("__r")).unionAll(
        right.where(F.col(right_ms).isNotNull()).select(*kcols, F.col(right_ms).cast("long"), F.lit(0), seq_r, none_l, rid)
    )
    ks = [f"__k{i}" for i in range(len(keys))]
    part = ks
    if bucket_ms is not None:
        both, part = both.withColumn("__bucket", F.floor(F.col("__t") / bucket_ms)), [*ks, "__bucket"]
    # Backward, right rows sort before left ones of the same time; forward, the whole order is reversed and they do again.
    back = Window.partitionBy(*part).orderBy("__t", "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*part).orderBy(F.col("__t").desc(), "__side", F.col("__seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both
    if bucket_ms is not None:
        along = Window.partitionBy(*ks).orderBy("__bucket")
        at = F.struct("__t", "__seq")
        theirs = F.when(F.col("__side") == 0, F.col("__r"))
        carried = both.groupBy(*part).agg(
            F.max_by(theirs, F.when(F.col("__side") == 0, at)).alias("__late"), F.min_by(theirs, F.when(F.col("__side") == 0, at)).alias("__early")
        ).select(
            *(F.col(c).alias(f"__c{c}") for c in part),
            F.last("__late", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__cb"),
            F.first("__early", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__cf"),
        )
        on = F.lit(True)
        for c in part:
            on = on & F.col(c).eqNullSafe(F.col(f"__c{c}"))
        out = both.join(carried, on).drop(*(f"__c{c}" for c in part))
    if direction in ("backward", "nearest"):
        out = out.withColumn("__b", F.last("__r", ignorenulls=True).over(back))
    if direction in ("forward", "nearest"):
        out = out.withColumn("__f", F.last("__r", ignorenulls=True).over(ahead))
    if bucket_ms is not None:
        for name, other in (("__b", "__cb"), ("__f", "__cf")):
            if name in out.columns:
                out = out.withColumn(name, F.coalesce(name, other))
    keyed = F.lit(True)
    for k in ks:
        keyed = keyed & F.col(k).isNotNull()

    def valid(name: str) -> Column:
        far = F.abs(F.col("__t") - F.col(f"{name}.{right_ms}"))
        ok = F.col(name).isNotNull() & F.col("__t").isNotNull() & keyed
        return ok & (far <= tolerance) if tolerance is not None else ok

    if direction == "nearest":
        db, df_ = F.abs(F.col("__t") - F.col(f"__b.{right_ms}")), F.abs(F.col("__t") - F.col(f"__f.{right_ms}"))
        out = out.withColumn("__m", F.when(valid("__b") & (~valid("__f") | (db <= df_)), F.col("__b")).when(valid("__f"), F.col("__f")))
    else:
        name = "__b" if direction == "backward" else "__f"
        out = out.withColumn("__m", F.when(valid(name), F.col(name)))
    out = out.where(F.col("__side") == 1)
    if how == "inner":
        out = out.where(F.col("__m").isNotNull())
    return out.select("__l.*", *(F.col(f"__m.{c}").alias(c + suffix if c in left.columns else c) for c in cols))


def temporal_join(left: DataFrame, versions: DataFrame, keys: list[str], ms: str, version: str, how: str = "inner", version_order: str | None = None) -> DataFrame:
    """Each row with the version of its key that was valid at its event time."""
    return asof_join(left, versions, keys, ms, version, "backward", None, how, right_order=version_order)


def latest(versions: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """The last version of each key."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__x")).select(*keys, "__x.*")


def process_time_join(left: DataFrame, versions: DataFrame, keys: list[str], *by: str, how: str = "inner") -> DataFrame:
    """Each row with the present version of its key."""
    v = latest(versions, keys, *by)
    return left.join(v.withColumnsRenamed(_right_names(left, v, keys, "right_")), keys, how)


def temporal_changes(left: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], by: list[str], row: list[str], values: list[str]) -> DataFrame:
    """What a change of the versions does to the inner process-time join with left, whose rows have the key row: -1 for what is no longer so, +1 for what is now.

    Only keys whose present version has changed are joined again."""
    old, new = (latest(v, keys, *by).select(*keys, *values) for v in (before, after))
    changed = diff(old, new, keys).select(*keys).distinct()
    rows = left.join(changed, keys, "left_semi")
    return diff(*(rows.join(v, keys).select(*row, *values) for v in (old, new)), row)


def recent_versions(versions: DataFrame, keys: list[str], n: int, *by: str) -> DataFrame:
    """The n most recent versions of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(b).desc() for b in by)))
    return versions.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def lookup_join(left: DataFrame, table: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """Enrichment by a table with one row a key; Spark broadcasts it where its size allows."""
    cond = None
    for a, b in on.items():
        c = left[a] == table[b]
        cond = c if cond is None else cond & c
    return left.join(table, cond, how)
