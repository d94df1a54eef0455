"""Online control charts: cumulative sums and the weighted mean of each record as its intervals arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.charts import Chart

STATE = "n long, total double, squares double, s_pos double, s_neg double, e double"
OUTPUT = "record_id long, idx long, rr_ms double, z double, s_pos double, s_neg double, ewma double, out_cusum boolean, out_ewma boolean"


ORDERED_STATE = "records binary, pending binary"
ORDERED_OUTPUT = OUTPUT + ", at long, late boolean"
PENDING = np.dtype([("record", "i8"), ("at", "i8"), ("order", "i8"), ("rr_ms", "f8")])
#: What is known of a record after each trigger.
RECORD = np.dtype([("record", "i8"), ("n", "i8"), *[(c, "f8") for c in ("total", "squares", "s_pos", "s_neg", "e")], ("released", "i8")])
#: Stands for the record of rows without an id, which are one record.
NO_RECORD = int(np.iinfo(np.int64).min)
#: Groups of records of the ordered monitor.
BUCKETS = 1024


def _step(x: float, total: float, squares: float, up: float, down: float, e: float, baseline: int, chart: Chart) -> tuple[float, float, float, float]:
    """(z, up, down, e) after one more interval."""
    mean = total / baseline
    spread = max(squares - baseline * mean * mean, 0.0) / max(baseline - 1, 1)
    z = (x - mean) / (spread**0.5 if spread > 0 else 1.0)
    return z, max(0.0, up + z - chart.k), max(0.0, down - z - chart.k), chart.weight * z + (1 - chart.weight) * e


def monitor(events: DataFrame, baseline: int = 20, chart: Chart = Chart()) -> DataFrame:
    """One row for each interval after the baseline, in append mode.

    ``events`` streams (record_id, ts, order, rr_ms). State is constant for each record: number, sum and squares of
    the first ``baseline`` intervals, then both cumulative sums and the weighted mean. Rows of one trigger are taken
    in order of (ts, order); a row that arrives in a later trigger than a younger one is charted when it arrives.
    """
    bound = chart.ewma_limit * (chart.weight / (2 - chart.weight)) ** 0.5

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares, up, down, e = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = []
        for x in pd.concat(list(frames)).sort_values(["ts", "order"])["rr_ms"].tolist():
            if n < baseline:
                total, squares = total + x, squares + x * x
            else:
                z, up, down, e = _step(x, total, squares, up, down, e, baseline, chart)
                rows.append((key[0], n, x, z, up, down, e, max(up, down) > chart.h, abs(e) > bound))
            n += 1
        state.update((n, total, squares, up, down, e))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("record_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def ordered_monitor(events: DataFrame, delay: int, baseline: int = 20, chart: Chart = Chart(), buckets: int = BUCKETS) -> DataFrame:
    """``monitor`` over rows that arrive up to ``delay`` out of order, with the rows that came later than that listed.

    ``events`` streams (record_id, at, order, rr_ms, last): ``at`` is a long in the unit of ``delay``. After each
    trigger a record's horizon is its largest ``at`` less ``delay``; rows before it are charted in order of
    (at, order), the others wait in state, which so holds the rows of one delay. A row of a later trigger before the
    horizon, or without ``at``, is late: it comes out with ``late`` true and no figures, and moves no chart. A row
    with ``last`` true ends its record (its value is not used): what waits is charted, all rows of later triggers
    are late. Rows with null or NaN ``rr_ms`` take no part. Triggers may cut the arrivals anywhere: without late
    rows, the result is that of ``monitor`` over all rows in order.

    Records are dealt to ``buckets``, whose records share one state, since every group has a cost of its own in each
    trigger. A stream must keep the number it began with.
    """
    bound = chart.ewma_limit * (chart.weight / (2 - chart.weight)) ** 0.5
    first, end = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    names = [c.split()[0] for c in ORDERED_OUTPUT.split(", ")]

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        facts, kept = state.get if state.exists else (b"", b"")
        held = {r[0]: r[1:] for r in np.frombuffer(bytes(facts), RECORD).tolist()}
        came = pd.concat(list(frames))
        ids = [None if pd.isna(i) else int(i) for i in came["record_id"].astype("Int64")]
        last = came["last"].fillna(False).astype(bool).to_numpy()
        values, times = came["rr_ms"].to_numpy(float, na_value=np.nan), came["at"].astype("Int64")
        timed = times.notna().to_numpy()
        at, order = times.fillna(0).to_numpy(np.int64), came["order"].astype("Int64").fillna(0).to_numpy(np.int64)
        slot = np.array([NO_RECORD if i is None else i for i in ids], np.int64)
        released = {i: held[i][6] if i in held else first for i in np.unique(slot).tolist()}
        horizon = np.array([released[i] for i in slot.tolist()], np.int64)
        use = ~last & ~np.isnan(values)
        late = use & (~timed | (at < horizon) | (horizon == end))
        name = lambda i: None if i == NO_RECORD else i
        rows = [(name(i), None, x, *[None] * 6, t if k else None, True) for i, x, t, k in zip(slot[late].tolist(), values[late].tolist(), at[late].tolist(), timed[late].tolist())]
        fresh = use & ~late
        new = np.zeros(int(fresh.sum()), PENDING)
        for c, v in (("record", slot), ("at", at), ("order", order), ("rr_ms", values)):
            new[c] = v[fresh]
        waiting = np.concatenate([np.frombuffer(bytes(kept), PENDING), new])
        waiting = waiting[np.lexsort((waiting["order"], waiting["at"], waiting["record"]))]
        ended = set(slot[last].tolist())
        # each record's rows lie next to each other
        edges = np.flatnonzero(np.append(True, waiting["record"][1:] != waiting["record"][:-1])).tolist() if len(waiting) else []
        spans = {int(waiting["record"][lo]): (lo, hi) for lo, hi in zip(edges, [*edges[1:], len(waiting)])}
        stay = np.ones(len(waiting), bool)
        for i in released:
            n, total, squares, up, down, e, gone = held.get(i, (0, 0.0, 0.0, 0.0, 0.0, 0.0, first))
            lo, hi = spans.get(i, (0, 0))
            own = waiting[lo:hi]
            if i in ended:
                gone = end
            elif len(own):
                gone = max(gone, int(own["at"][-1]) - delay)
            ready = len(own) if i in ended else int(np.searchsorted(own["at"], gone))
            for t, x in zip(own["at"][:ready].tolist(), own["rr_ms"][:ready].tolist()):
                if n < baseline:
                    total, squares = total + x, squares + x * x
                else:
                    z, up, down, e = _step(x, total, squares, up, down, e, baseline, chart)
                    rows.append((name(i), n, x, z, up, down, e, max(up, down) > chart.h, abs(e) > bound, t, False))
                n += 1
            stay[lo : lo + ready] = False
            held[i] = (n, total, squares, up, down, e, gone)
        packed = np.array([(i, *v) for i, v in held.items()], RECORD)
        state.update((packed.tobytes(), waiting[stay].tobytes()))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"record_id": "Int64", "idx": "Int64", "at": "Int64", "out_cusum": "boolean", "out_ewma": "boolean", "late": "boolean", "z": "float64", "s_pos": "float64", "s_neg": "float64", "ewma": "float64"})

    dealt = events.withColumn("_bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(run, ORDERED_OUTPUT, ORDERED_STATE, "append", GroupStateTimeout.NoTimeout)
