"""Operators that take a stream's rows in the order of event time, key by key: ASOF joins, lag and lead.

A row's place is settled once the watermark has passed it, for no earlier row can come then. Till
then it waits in the key's state, as its time and its columns in JSON; times are microseconds.
Rows that come below the watermark are dropped by Spark."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.rewrite import EVENT_TIME

#: How columns are written into a state and read again.
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _payload(columns: list[str]) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), _JSON)


def _wake(state: GroupState, times: list[int]) -> None:
    """Call again once the watermark has passed the earliest of the times."""
    if times:
        state.setTimeoutTimestamp(max(min(times) // 1000, state.getCurrentWatermarkMs() + 1))


def asof_stream(left: DataFrame, right: DataFrame, keys: list[str], direction: str = "backward", tolerance_ms: int | None = None, how: str = "left", suffix: str = "_right") -> DataFrame:
    """Each row of the stream left with the row of its key in the stream right that is nearest in event time.

    backward: the latest at or before, of equal times the last; forward: the earliest at or after,
    of equal times the first; nearest: the nearer of both, backward on a tie; no match beyond the
    tolerance. Both streams have their watermark on EVENT_TIME. A left row goes out once no row can
    come that would be a better match. Of right rows, a key keeps those that one may still match."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction: {direction}")
    mine = [c for c in left.columns if c != EVENT_TIME]
    theirs = [c for c in right.columns if c != EVENT_TIME and c not in keys]
    names = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, n: int, columns: list[str]) -> DataFrame:
        return df.select(*(F.col(k).alias(x) for k, x in zip(keys, names, strict=True)), F.lit(n).alias("side"), F.unix_micros(EVENT_TIME).alias("t"), _payload(columns).alias("p"), EVENT_TIME)

    most = None if tolerance_ms is None else tolerance_ms * 1000

    def best(lt: int, rt: list[int], mark: int) -> tuple[bool, int | None]:
        """Whether the match of a row at lt is settled, and its place in the ascending rt."""
        back = bisect_right(rt, lt) - 1
        ahead = bisect_left(rt, lt)
        b = back if back >= 0 and (most is None or lt - rt[back] <= most) else None
        f = ahead if ahead < len(rt) and (most is None or rt[ahead] - lt <= most) else None
        if direction == "backward":
            return lt < mark, b
        if direction == "nearest" and b is not None and (f is None or lt - rt[b] <= rt[f] - lt):
            # A nearer one could come up to the same distance ahead.
            return lt + (lt - rt[b]) < mark, b
        known = f is not None and rt[f] < mark
        return known or (most is not None and lt + most < mark), f

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lt, lp, rt, rp = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        for pdf in frames:
            for side, t, p in zip(pdf["side"].tolist(), pdf["t"].tolist(), pdf["p"].tolist(), strict=True):
                (lt if side == 0 else rt).append(t)
                (lp if side == 0 else rp).append(p)
        order = sorted(range(len(rt)), key=rt.__getitem__)  # of equal times in order of arrival
        rt, rp = [rt[i] for i in order], [rp[i] for i in order]
        mark = state.getCurrentWatermarkMs() * 1000
        whole = all(k is not None and k == k for k in key)
        out, wait = [], []
        for t, p in zip(lt, lp, strict=True):
            done, at = best(t, rt, mark) if whole else (True, None)
            if not done:
                wait.append((t, p))
            elif at is not None or how == "left":
                out.append((p, None if at is None else rp[at]))
        # Rows to come are not below the mark: of the right rows before all of them and all that wait, the last can still match.
        low = min([mark, *(t for t, _ in wait)])
        first = max(0, bisect_right(rt, low) - 1)
        if direction == "forward":
            first = bisect_left(rt, low)
        rt, rp = ([], []) if not whole else (rt[first:], rp[first:])
        if wait or rt:
            state.update(([t for t, _ in wait], [p for _, p in wait], rt, rp))
            due = []
            for t, _ in wait:
                b, f = bisect_right(rt, t) - 1, bisect_left(rt, t)
                near = [t] if direction == "backward" else rt[f : f + 1] + ([t + most] if most is not None else [])
                if direction == "nearest" and b >= 0:
                    near.append(t + (t - rt[b]))
                due += [min(near)] if near else []
            _wake(state, due)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["l", "r"])

    both = side(left, 0, mine).unionByName(side(right, 1, theirs))
    kept = "lt array<bigint>, lp array<string>, rt array<bigint>, rp array<string>"
    met = both.groupBy(*names).applyInPandasWithState(step, "l string, r string", kept, "append", GroupStateTimeout.EventTimeTimeout)
    lefts, rights = T.StructType([left.schema[c] for c in mine]), T.StructType([right.schema[c] for c in theirs])
    rows = met.select(F.from_json("l", _ddl(lefts), _JSON).alias("l"), F.from_json("r", _ddl(rights), _JSON).alias("r"))
    return rows.select("l.*", *(F.col(f"r.`{c}`").alias(c + suffix if c in mine else c) for c in theirs))


def _ddl(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def lags_stream(df: DataFrame, keys: list[str], calls: list[tuple[str, str, str, int, object]]) -> DataFrame:
    """The stream df with a column for each call (name, 'lag' or 'lead', column, n, default), by key in order of event time.

    A lag is settled once the watermark has passed the row, a lead once it has passed the n-th row
    after it; when it has passed all rows that a key has, leads that still wait get the default."""
    columns = [c for c in df.columns if c != EVENT_TIME]
    values = sorted({c for _, _, c, _, _ in calls})
    back = max([0, *(n for _, kind, _, n, _ in calls if kind == "lag")])
    ahead = max([0, *(n for _, kind, _, n, _ in calls if kind == "lead")])
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(x) for k, x in zip(keys, names, strict=True)), F.unix_micros(EVENT_TIME).alias("t"), _payload(columns).alias("p"), EVENT_TIME)
    outs = [f"o{i}" for i in range(len(calls))]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            held += [(t, p, False) for t, p in zip(pdf["t"].tolist(), pdf["p"].tolist(), strict=True)]
        held.sort(key=lambda r: r[0])
        mark = state.getCurrentWatermarkMs() * 1000
        settled = bisect_left([r[0] for r in held], mark)
        flush = settled == len(held)
        out = []
        for i in range(settled):
            t, p, done = held[i]
            if done or not (flush or i + ahead < settled):
                continue
            held[i] = (t, p, True)
            # A neighbour's whole row goes along; its column is taken from it in SQL.
            at = [i - n if kind == "lag" else i + n for _, kind, _, n, _ in calls]
            out.append((p, *(held[j][1] if 0 <= j < settled else None for j in at)))
        first = next((i for i, r in enumerate(held) if not r[2]), len(held))
        held = held[max(0, first - back) :]
        if held:
            state.update(tuple(list(x) for x in zip(*held, strict=True)))
            _wake(state, [t for t, _, _ in held if t >= mark])
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["p", *outs])

    schema = "p string, " + ", ".join(f"{o} string" for o in outs)
    found = rows.groupBy(*names).applyInPandasWithState(step, schema, "t array<bigint>, p array<string>, done array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
    whole = _ddl(T.StructType([df.schema[c] for c in columns]))
    own = _ddl(T.StructType([df.schema[c] for c in values]))
    found = found.select(F.from_json("p", whole, _JSON).alias("r"), *(F.from_json(o, own, _JSON).alias(o) for o in outs))
    got = [
        F.when(F.col(o).isNull(), F.lit(default).cast(df.schema[column].dataType)).otherwise(F.col(f"{o}.`{column}`")).alias(name)
        for o, (name, _, column, _, default) in zip(outs, calls, strict=True)
    ]
    return found.select("r.*", *got)
