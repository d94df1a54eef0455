"""Linear models of all folds and blocks of features over the same rows, without a copy of the rows for each model.

Rows are packed in chunks by cell (the keys that tell features apart). Medians, scales, coefficients and sigmoids of all
models of a cell lie in one row, which meets the cell's chunks; a Newton step is one pass for all of them. The driver
sees one number a step.
"""

from __future__ import annotations


from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model_table import ROWS_A_TASK, _equations
from .scan import attach, written
from .selection import exact_percentiles

#: What a row is to a set: neither, of its training rows, or held out.
NEITHER, TRAIN, HELD = 0, 1, 2
#: Rows of one chunk.
CHUNK = 1024
#: Cells whose rows of numbers are broadcast to the chunks; more are joined by name.
BROADCAST_CELLS = 2_000


@dataclass(frozen=True)
class Models:
    """Which models every cell has: one for each set of training rows and block of features; with ``parts`` one for each part left out.

    ``blocks`` maps names to places in x. With ``untrained``, models without training rows have coefficients of 0 and
    are not left out.
    """

    p: int
    sets: int
    blocks: dict[str, tuple[int, ...]]
    parts: int = 0
    loss: str = "logistic"
    plain_intercept: bool = True
    untrained: bool = False

    @property
    def fits(self) -> list[tuple[int, int]]:
        """(set, part left out); 0 leaves none out."""
        return [(s, o) for s in range(self.sets) for o in (range(1, self.parts + 1) if self.parts else (0,))]

    @property
    def columns(self) -> list[np.ndarray]:
        return [np.array(c, int) for c in self.blocks.values()]


def places(names: Sequence[str], blocks: dict[str, list[str]]) -> dict[str, tuple[int, ...]]:
    return {b: tuple(names.index(c) for c in own) for b, own in blocks.items()}


def fold_sides(fold: Column, folds: int) -> Column:
    """The sides of a row in the sets that hold out each fold."""
    return F.array(*[F.when(fold == k, HELD).otherwise(TRAIN) for k in range(1, folds + 1)])


@dataclass
class Cells:
    """Packed rows, and the medians that missing values take in every set."""

    chunks: DataFrame
    fill: DataFrame
    keep: str


def packed(rows: DataFrame, cell: Sequence[str], names: Sequence[str], sides: Column, sets: int, keep: Sequence[str], part: Column | None = None) -> Cells:
    """The rows by cell. ``sides`` has one of NEITHER, TRAIN and HELD for each of ``sets``; ``keep`` comes back with predictions and tells rows apart.

    Nulls and NaN are missing; medians are taken only of columns that miss values somewhere.
    """
    cell, p = list(cell), len(names)
    clean = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names]
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cell])
    own = (F.lit(0) if part is None else part).cast("int")
    flat = rows.select(key.alias("cell"), F.array(*clean).alias("x"), F.col("y").cast("double").alias("y"), sides.cast("array<int>").alias("side"), own.alias("part"), F.struct(*keep).alias("keep"))
    each = flat.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.isnan(F.col("x")[j])).alias(f"_{j}") for j in range(p)])
    found = each.agg(F.max("_n").alias("most"), F.sum("_n").alias("total"), *[F.max(f"_{j}").alias(f"_{j}") for j in range(p)]).head()
    most, total = found["most"] or 0, found["total"] or 0
    session = rows.sparkSession
    task_rows = min(ROWS_A_TASK, max(CHUNK, -(-total // (4 * session.sparkContext.defaultParallelism))))
    # more parts than cores, so that a pass deals them evenly
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism, -(-total // ROWS_A_TASK))
    chunk = F.pmod(F.xxhash64("keep"), F.lit(max(1, -(-most // CHUNK))))
    dealt = flat.withColumn("_c", chunk).withColumn("_s", F.pmod("_c", F.lit(max(1, -(-most // task_rows))))).repartition(tasks, "cell", "_s")
    chunks = dealt.groupBy("cell", "_s", "_c").agg(F.collect_list(F.struct("x", "y", "side", "part", "keep")).alias("rows"))
    chunks = written(chunks.sortWithinPartitions("cell").select("cell", "rows"), "chunks")
    none = F.array_repeat(F.lit(0.0), sets * p)
    fill = chunks.select("cell").distinct().withColumn("fill", none)
    missing = [j for j in range(p) if found[f"_{j}"]]
    if missing:
        seen = flat.select("cell", "x", F.posexplode("side").alias("_s", "_side")).where(F.col("_side") == TRAIN)
        pairs = F.array(*[F.struct((F.col("_s") * p + j).alias("i"), F.col("x")[j].alias("v")) for j in missing])
        middle = exact_percentiles(seen.select("cell", F.inline(pairs)), ["cell", "i"], F.col("v"), [0.5])
        known = middle.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("_m"))
        of = F.transform(F.sequence(F.lit(0), F.lit(sets * p - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
        fill = attach(fill.drop("fill"), known, ["cell"], "left").select("cell", F.when(F.col("_m").isNull(), none).otherwise(of).alias("fill"))
    kept = flat.select("keep").schema[0].dataType.simpleString()
    return Cells(chunks, written(fill, "cells"), kept)


def _chunks(batch: pa.RecordBatch, p: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    lists = batch.column("rows")
    rows = lists.flatten()
    x, y, side, part, keep = (rows.field(c) if not rows.offset else rows.flatten()[i] for i, c in enumerate(("x", "y", "side", "part", "keep")))
    x, y, part = x.flatten().to_numpy().reshape(-1, p), y.to_numpy(), part.to_numpy()
    side = side.flatten().to_numpy().reshape(len(y), -1)
    ends = np.cumsum(lists.value_lengths().to_numpy())
    for i, (name, lo, hi) in enumerate(zip(batch.column("cell").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist())):
        yield name, i, x[lo:hi], y[lo:hi], side[lo:hi], part[lo:hi], keep.slice(lo, hi - lo)


#: The column of gradients and Hessians.
_SUMS = "sums"


def _array(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy()


def _batch(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    """Rows of a cell's name and arrays of numbers; sums, which are long, as bytes."""
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    types = [pa.string(), *[pa.binary() if c == _SUMS else pa.list_(pa.float64()) for c in names[1:]]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(names))


def _schema(names: Sequence[str]) -> str:
    return ", ".join([f"{names[0]} string", *[f"{c} binary" if c == _SUMS else f"{c} array<double>" for c in names[1:]]])


_MOMENTS = ["cell", "n", "mean", "m2", "up", "down"]
_FACTS = ["cell", "mean", "dev", "up", "down"]


def _met(a, b):
    """Counts, means and squared deviations of two parts of the rows, together; exact where both are of one value."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)[:, None]
    far = b[1] - a[1]
    return n, a[1] + far * share, a[2] + b[2] + far * far * share * a[0][:, None], a[3] + b[3], a[4] + b[4]


def _moments(m: Models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, None
        for batch in batches:
            out = []
            for name, i, x, y, side, part, _ in _chunks(batch, m.p):
                fill = _array(batch, "fill", i).reshape(m.sets, m.p)
                n, mean, m2 = np.zeros(m.sets), np.zeros((m.sets, m.p)), np.zeros((m.sets, m.p))
                for s in range(m.sets):
                    own = side[:, s] == TRAIN
                    n[s] = own.sum()
                    if n[s]:
                        v = np.where(np.isnan(x[own]), fill[s], x[own])
                        away = v - v[0]
                        mean[s] = v[0] + away.mean(0)
                        m2[s] = ((away - away.mean(0)) ** 2).sum(0)
                inside = [(side[:, s] == TRAIN) & (part == o) for s, o in m.fits]
                now = n, mean, m2, np.array([float((k & (y == 1)).sum()) for k in inside]), np.array([float((k & (y != 1)).sum()) for k in inside])
                if name != held and held is not None:
                    out.append((held, *[v.ravel() for v in sums]))
                sums = _met(sums, now) if name == held else now
                held = name
            yield _batch(out, _MOMENTS)
        if held is not None:
            yield _batch([(held, *[v.ravel() for v in sums])], _MOMENTS)

    return run


def _scales(m: Models):
    """Means and deviations of each cell's sets from the parts that lie next to each other; a deviation of 0 counts as 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, None

        def row():
            n, mean, m2, up, down = sums
            dev = np.sqrt(m2 / np.maximum(n, 1)[:, None])
            return held, mean.ravel(), np.where(dev > 0, dev, 1.0).ravel(), up, down

        for batch in batches:
            out = []
            for i, name in enumerate(batch.column("cell").to_pylist()):
                n, mean, m2, up, down = (_array(batch, c, i) for c in _MOMENTS[1:])
                now = n, mean.reshape(-1, m.p), m2.reshape(-1, m.p), up, down
                if name != held and held is not None:
                    out.append(row())
                sums = _met(sums, now) if name == held else now
                held = name
            yield _batch(out, _FACTS)
        if held is not None:
            yield _batch([row()], _FACTS)

    return run


class _Design:
    """Scaled rows of a chunk, for one set after another."""

    def __init__(self, m: Models, batch: pa.RecordBatch, i: int, x: np.ndarray):
        self.x = x
        self.fill, self.mean, self.dev = (_array(batch, c, i).reshape(m.sets, m.p) for c in ("fill", "mean", "dev"))
        self.gaps = np.isnan(x)
        self.holes = self.gaps.any()

    def scaled(self, s: int) -> np.ndarray:
        x = np.where(self.gaps, self.fill[s], self.x) if self.holes else self.x
        return np.concatenate([(x - self.mean[s]) / self.dev[s], np.ones((len(x), 1))], 1)


def _starts(m: Models) -> np.ndarray:
    """Where the coefficients of each fit's blocks begin."""
    sizes = [len(c) + 1 for _ in m.fits for c in m.columns]
    return np.concatenate([[0], np.cumsum(sizes)])


def _with_one(columns: np.ndarray) -> np.ndarray:
    """Places of a block's columns and of the intercept, which is last."""
    return np.append(columns, -1)


def _sigmoid_aim(y: np.ndarray, up: float, down: float) -> np.ndarray:
    return np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))


def _step_sums(m: Models, tolerance: float, sigmoids: bool, carried: Sequence[str]):
    """What is ``carried`` of a cell, with gradients and Hessians of all open models of a cell; of the machines, or of the sigmoids of their scores."""
    starts, columns = _starts(m), [_with_one(c) for c in m.columns]
    blocks = len(columns)
    widths = [2 if sigmoids else len(c) + 1 for _ in m.fits for c in m.columns]
    at = np.concatenate([[0], np.cumsum([w * (w + 1) + 1 for w in widths])])
    theta_at = np.concatenate([[0], np.cumsum(widths)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, state = None, None, None
        for batch in batches:
            out = []
            for name, i, x, y, side, part, _ in _chunks(batch, m.p):
                if name != held:
                    if held is not None:
                        out.append((held, *state, sums.tobytes()))
                    held, sums, state = name, np.zeros(at[-1]), [_array(batch, c, i) for c in carried]
                design, theta, move = _Design(m, batch, i, x), _array(batch, "theta", i), _array(batch, "move", i)
                if sigmoids:
                    beta, up, down = (_array(batch, c, i) for c in ("beta", "up", "down"))
                last = None
                for f, (s, o) in enumerate(m.fits):
                    open_ = [b for b in range(blocks) if move[f * blocks + b] >= tolerance]
                    if not open_:
                        continue
                    if s != last:
                        last, scaled = s, design.scaled(s)
                    own = side[:, s] == TRAIN
                    own &= (part == o) if sigmoids else (part != o) if o else True
                    if not own.any():
                        continue
                    whole, aim = np.ascontiguousarray(scaled[own].T), y[own]
                    for b in open_:
                        k = f * blocks + b
                        v = whole[columns[b]].T
                        target = aim
                        if sigmoids:
                            v = np.column_stack([v @ beta[starts[k] : starts[k + 1]], np.ones(len(v))])
                            target = _sigmoid_aim(aim, up[f], down[f])
                        pull, weight = _equations(v, target, theta[theta_at[k] : theta_at[k + 1]], "logistic" if sigmoids else m.loss)
                        sums[at[k] : at[k + 1]] += np.concatenate([[len(v)], v.T @ pull, ((v.T * weight) @ v).ravel()])
            yield _batch(out, ["cell", *carried, _SUMS])
        if held is not None:
            yield _batch([(held, *state, sums.tobytes())], ["cell", *carried, _SUMS])

    return run


def _solved(m: Models, tolerance: float, sigmoids: bool, carried: Sequence[str]):
    """The next coefficients of each cell's open models, how far they moved, and how many rows each model has."""
    widths = [2 if sigmoids else len(c) + 1 for _ in m.fits for c in m.columns]
    at = np.concatenate([[0], np.cumsum([w * (w + 1) + 1 for w in widths])])
    theta_at = np.concatenate([[0], np.cumsum(widths)])

    def solve(name, state, sums):
        theta, move, seen = state[-3:]
        theta, move, seen = theta.copy(), move.copy(), seen.copy()
        for k, w in enumerate(widths):
            if move[k] < tolerance:
                continue
            own = sums[at[k] : at[k + 1]]
            seen[k], move[k] = own[0], 0.0
            if own[0]:
                ridge = np.full(w, 0.0 if sigmoids else 1.0)
                if m.plain_intercept:
                    ridge[-1] = 0.0
                now = theta[theta_at[k] : theta_at[k + 1]]
                step = np.linalg.solve(own[1 + w :].reshape(w, w) + np.diag(ridge + 1e-12), own[1 : 1 + w] - ridge * now)
                theta[theta_at[k] : theta_at[k + 1]] = now + step
                move[k] = np.abs(step).max()
        return name, *state[:-3], theta, move, seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, sums = None, None, None
        for batch in batches:
            out = []
            for i, name in enumerate(batch.column("cell").to_pylist()):
                if name != held:
                    if held is not None:
                        out.append(solve(held, state, sums))
                    held, sums, state = name, np.zeros(at[-1]), [_array(batch, c, i) for c in carried]
                sums = sums + np.frombuffer(batch.column(_SUMS)[i].as_buffer())
            yield _batch(out, ["cell", *carried])
        if held is not None:
            yield _batch([solve(held, state, sums)], ["cell", *carried])

    return run


def _newton(cells: Cells, facts: DataFrame, m: Models, sigmoids: bool, rounds: int, tolerance: float) -> DataFrame:
    """(cell, theta, seen): steps until no model of any cell moves; cells at rest take no further part."""
    models = len(m.fits) * len(m.columns)
    size = 2 * models if sigmoids else int(_starts(m)[-1])
    start = facts.withColumns({"theta": F.array_repeat(F.lit(0.0), size), "move": F.array_repeat(F.lit(float("inf")), models), "seen": F.array_repeat(F.lit(0.0), models)})
    state = written(start, "cells")
    carried = [c for c in state.columns if c != "cell"]
    few = state.count() <= BROADCAST_CELLS
    done = None
    for _ in range(rounds):
        met = cells.chunks.join(F.broadcast(state) if few else state, "cell").select("cell", "rows", *carried)
        sums = met.mapInArrow(_step_sums(m, tolerance, sigmoids, carried), _schema(["cell", *carried, _SUMS]))
        moved = written(sums.repartition("cell").sortWithinPartitions("cell").mapInArrow(_solved(m, tolerance, sigmoids, carried), _schema(["cell", *carried])), "cells")
        moves = F.exists("move", lambda v: v >= tolerance)
        rested = moved.where(~moves).select("cell", "theta", "seen")
        done = rested if done is None else done.unionByName(rested)
        state = moved.where(moves)
        if state.isEmpty():
            return written(done, "cells")
    return written(done.unionByName(state.select("cell", "theta", "seen")), "cells")


def fitted(cells: Cells, m: Models, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """One row for each cell: fill, mean, dev, beta and seen of all its models, with ``parts`` the sigmoids of their scores too.

    A machine's sigmoid is a logistic model of its scores on the training rows of the part left out, with targets drawn
    in by one row of each class.
    """
    gathered = attach(cells.chunks, cells.fill, ["cell"]).mapInArrow(_moments(m), _schema(_MOMENTS))
    scales = gathered.repartition("cell").sortWithinPartitions("cell").mapInArrow(_scales(m), _schema(_FACTS))
    facts = written(attach(cells.fill, scales, ["cell"]), "cells")
    found = written(attach(facts, _newton(cells, facts, m, False, rounds, tolerance).withColumnRenamed("theta", "beta"), ["cell"]), "cells")
    if not m.parts:
        return found
    return written(attach(found, _newton(cells, found.drop("seen"), m, True, rounds, tolerance).select("cell", F.col("theta").alias("sigmoid")), ["cell"]), "cells")


def _predicted(m: Models):
    starts, columns = _starts(m), [_with_one(c) for c in m.columns]
    blocks = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, i, x, _, side, _, keep in _chunks(batch, m.p):
                design, beta, seen = _Design(m, batch, i, x), _array(batch, "beta", i), _array(batch, "seen", i)
                if m.parts:
                    sigmoid, up, down = (_array(batch, c, i) for c in ("sigmoid", "up", "down"))
                rows, sets, names, values = [], [], [], []
                for s in range(m.sets):
                    own = np.flatnonzero(side[:, s] == HELD)
                    if not len(own):
                        continue
                    scaled = design.scaled(s)[own]
                    for b in range(blocks):
                        guesses = []
                        for f in (f for f, (t, _) in enumerate(m.fits) if t == s):
                            k = f * blocks + b
                            if not (seen[k] or m.untrained) or (m.parts and not up[f] + down[f]):
                                continue
                            score = scaled[:, columns[b]] @ beta[starts[k] : starts[k + 1]]
                            if m.parts:
                                score = score * sigmoid[2 * k] + sigmoid[2 * k + 1]
                            guesses.append(1 / (1 + np.exp(-score)))
                        if guesses:
                            rows.append(own)
                            sets.append(np.full(len(own), s))
                            names.append(np.full(len(own), b))
                            values.append(np.mean(guesses, 0))
                if rows:
                    taken = keep.take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([taken, pa.array(np.concatenate(sets), pa.int32()), pa.array(np.concatenate(names), pa.int32()), pa.array(np.concatenate(values))], names=["keep", "s", "b", "p"])

    return run


def predictions(cells: Cells, table: DataFrame, m: Models) -> DataFrame:
    """Held-out rows by set (``s``, from 0) and block, with ``p``; of the machines the mean of their sigmoids.

    A machine without training rows, or without rows of the part left out, is left out.
    """
    met = attach(cells.chunks, table, ["cell"]).mapInArrow(_predicted(m), f"keep {cells.keep}, s int, b int, p double")
    block = F.element_at(F.array(*[F.lit(b) for b in m.blocks]), F.col("b") + 1)
    return met.select("keep.*", "s", block.alias("block"), "p")


def coefficients(table: DataFrame, m: Models) -> DataFrame:
    """(cell, s, block, i, coef): coefficients of the fits that have rows (of all if ``untrained``), without intercepts; ``i`` is a place in the block."""
    starts = _starts(m).tolist()
    blocks = list(m.blocks)
    each = [(s, b, f * len(blocks) + j) for f, (s, _) in enumerate(m.fits) for j, b in enumerate(blocks)]
    made = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(b).alias("block"), F.col("seen")[k].alias("n"), F.slice("beta", starts[k] + 1, starts[k + 1] - starts[k] - 1).alias("coefs")) for s, b, k in each])
    return table.select("cell", F.inline(made)).where("true" if m.untrained else "n > 0").select("cell", "s", "block", F.posexplode("coefs").alias("i", "coef"))
