"""Moving average and running best over a stream of metric rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import KEY, moving_average, running_best

OUTPUT = "run_id bigint, iter bigint, value double, ema double, best_before double, improved boolean, late boolean"
STATE = "seen bigint, ema double, best double, last bigint, newest bigint, iters array<bigint>, waiting array<double>"


def running_metrics(
    stream: DataFrame, metric: str, keep: float = 0.9, skip: int = 5, step: str = "iter", slack: int = 0, idle: str | None = None
) -> DataFrame:
    """Every metric row with the average and best of its run so far.

    Rows may come up to ``slack`` iterations after later ones: a run's rows of the newest ``slack`` iterations
    wait in its state until newer ones release them, in order. They are released without that by a row
    of the run whose iteration is null, which closes it, or after ``idle`` (such as ``10 minutes``) without
    any row, for streams that keep running. Inside one trigger the order is restored anyway; a trigger's size
    and ``slack`` bound what one run can hold. A row behind the last one released is passed on with
    ``late`` set and without results; its run has to be recomputed (``repaired``).
    """
    timer = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ema, best, last, newest, iters, waiting = state.get if state.exists else (0, None, None, None, None, [], [])
        expired = state.hasTimedOut
        arrived = pd.concat(list(frames)) if not expired else pd.DataFrame({"iter": [], "value": []})
        closed = expired or bool(arrived["iter"].isna().any())
        arrived = arrived[arrived["iter"].notna() & arrived["value"].notna()]
        out = []
        rows = list(zip(iters, waiting))
        for at, value in zip(arrived["iter"].astype("int64").tolist(), arrived["value"].tolist()):
            if last is not None and at <= last:
                out.append((key[0], at, value, None, None, None, True))
            else:
                rows.append((at, value))
        rows.sort(key=lambda r: r[0])
        newest = max([r[0] for r in rows] + ([] if newest is None else [newest]), default=None)
        ready = [r for r in rows if closed or r[0] <= newest - slack]
        for at, value in ready:
            if seen >= skip:
                ema = value if ema is None else keep * ema + (1.0 - keep) * value
            out.append((key[0], at, value, ema, best, best is None or value < best, False))
            best = value if best is None else min(best, value)
            seen, last = seen + 1, at
        rest = rows[len(ready) :]
        state.update((seen, ema, best, last, newest, [r[0] for r in rest], [r[1] for r in rest]))
        if wait is not None and rest:
            state.setTimeoutDuration(wait)
        columns = [c.split()[0] for c in OUTPUT.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        frame["improved"] = frame["improved"].astype("boolean")
        yield frame

    rows = stream.filter(F.col(metric).isNotNull() | F.col(step).isNull()).select(
        F.col(KEY).cast("bigint").alias("run_id"), F.col(step).cast("bigint").alias("iter"), F.col(metric).alias("value")
    )
    return rows.groupBy("run_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", timer)


def repaired(results: DataFrame, history: DataFrame, metric: str, keep: float = 0.9, skip: int = 5) -> DataFrame:
    """Stream results with the runs that had late rows computed anew from the history."""
    late = results.filter("late").select("run_id").distinct()
    redo = history.join(late, KEY, "left_semi").select(KEY, "iter", F.col(metric).alias("value"))
    best = running_best(redo, "value")
    average = moving_average(redo, "value", keep, skip).select(KEY, "iter", "ema")
    again = best.join(average, [KEY, "iter"], "left")
    fine = results.join(late, "run_id", "left_anti").drop("late")
    return fine.unionByName(again.select(*fine.columns))
