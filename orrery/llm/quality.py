"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_bucket, prefix_code, range_hash, small_batches, sub_batches, text_batches, utf8, word_spans

#: At most so many labelled documents, those with the smallest id hashes, are used to fit.
SAMPLE_DOCS = 4000
#: Lines of sampled documents that reach the driver at most; documents over it in total are left out of the fit.
SAMPLE_LINES = 100_000
THRESHOLD = 0.3


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_BLANK = _class(" \t\r\v\f")
_STOP = _class(".,;:?")
_BANG = _class("!")
_SIGN = _class("#$%&*@^~+=")
_BAR = _class("|")
_PAIR = _class("()[]{}<>\"'`")
_DASH = _class("-_/\\")
_OTHER = np.zeros(256, np.uint64)
_OTHER[128:] = 1
_CONTROL = np.zeros(256, np.uint64)
_CONTROL[[*range(0, 9), *range(14, 32), 127]] = 1
_FIELDS = [_UPPER, _LOWER, _DIGIT, _BLANK, _STOP, _BANG, _SIGN, _BAR, _PAIR, _DASH, _OTHER, _CONTROL]
_NEWLINE = 10
#: Features of one line; each line sees its own and those of the lines before and after it.
LINE_FEATURES = len(_FIELDS) + 10
FEATURES = 3 * LINE_FEATURES + 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and each row's first line; a row without text has one empty line."""
    breaks = np.flatnonzero(data == _NEWLINE)
    rows = np.searchsorted(offsets, breaks, side="right") - 1
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    starts[first[:-1]] = offsets[:-1]
    ends[first[1:] - 1] = offsets[1:]
    at = np.arange(len(breaks)) + rows
    starts[at + 1] = breaks + 1
    ends[at] = breaks
    return starts, ends, first


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, each row's first line, and the lines' lengths in bytes."""
    starts, ends, first = line_spans(data, offsets)
    n = len(starts)
    size = ends - starts
    counts = np.empty((n, len(_FIELDS)))
    for k in range(0, len(_FIELDS), 2):
        both = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FIELDS[k] | (_FIELDS[k + 1] << np.uint64(32)))[data], out=both[1:])
        cut = both[ends] - both[starts]
        counts[:, k], counts[:, k + 1] = cut & np.uint64(0xFFFFFFFF), cut >> np.uint64(32)
    blank = (_BLANK[data] > 0) | (data == _NEWLINE)
    last = np.ones(len(data), bool)
    last[:-1] = blank[1:]
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    odd = (_BANG | _SIGN | _BAR)[data] > 0
    word_end = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((last & ~blank).astype(np.uint64) | ((last & odd).astype(np.uint64) << np.uint64(32)), out=word_end[1:])
    cut = word_end[ends] - word_end[starts]
    words, odd_words = (cut & np.uint64(0xFFFFFFFF)).astype(float), (cut >> np.uint64(32)).astype(float)
    filled = size > 0
    end_byte = np.zeros(n, np.uint8)
    end_byte[filled] = data[ends[filled] - 1]
    start_byte = np.zeros(n, np.uint8)
    start_byte[filled] = data[starts[filled]]
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    prefix = prefix_code(data)
    word_starts, word_ends, _ = word_spans(data, offsets)
    word = range_hash(prefix, word_starts, word_ends)
    again = np.zeros(len(word) + 1)
    np.cumsum(word[1:] == word[:-1], out=again[2:])
    in_line = np.searchsorted(word_starts, np.stack([starts, ends]))
    again = np.maximum(again[in_line[1]] - again[np.minimum(in_line[0] + 1, len(word))], 0)
    code = range_hash(prefix, starts, ends) ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    x = np.zeros((n, LINE_FEATURES))
    per = 1.0 / np.maximum(size, 1)
    x[:, : len(_FIELDS)] = np.sqrt(counts * per[:, None])
    k = len(_FIELDS)
    x[:, k] = np.log1p(size)
    x[:, k + 1] = np.log1p(words)
    x[:, k + 2] = np.minimum(size / np.maximum(words, 1), 30.0)
    x[:, k + 3] = odd_words / np.maximum(words, 1)
    x[:, k + 4] = np.log(times[back])
    x[:, k + 5] = (_STOP[end_byte] > 0) | (end_byte == ord("!"))
    x[:, k + 6] = (_UPPER[start_byte] > 0) | (start_byte >= 128)
    x[:, k + 7] = ~filled
    x[:, k + 8] = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    x[:, k + 9] = again / np.maximum(words, 1)
    full = np.ones((n, FEATURES))
    full[:, :LINE_FEATURES] = x
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    full[:, LINE_FEATURES : 2 * LINE_FEATURES] = 0
    full[1:, LINE_FEATURES : 2 * LINE_FEATURES] = x[:-1] * inner[1:, None]
    full[:, 2 * LINE_FEATURES : 3 * LINE_FEATURES] = 0
    full[:-1, 2 * LINE_FEATURES : 3 * LINE_FEATURES] = x[1:] * inner[1:, None]
    return full, first, size


@dataclass(frozen=True)
class LineModel:
    """Weights of standardized features, log transition scores (bad, good), and the document calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """P(good) of every line by forward-backward; adds expected transitions to ``pairs`` if given."""
        u = np.clip(((x - self.mean) * self.scale) @ self.weights, -30, 30)
        good = 1.0 / (1.0 + np.exp(-u))
        emit = np.stack([1.0 - good, good], 1)
        step = np.exp(self.moves)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        head = first[:-1][order]
        active = np.searchsorted(-size[order], -np.arange(size.max() if len(size) else 0), side="left")
        alpha = np.empty_like(emit)
        for t, n in enumerate(active.tolist()):
            at = head[:n] + t
            now = emit[at] if t == 0 else (alpha[at - 1] @ step) * emit[at]
            alpha[at] = now / now.sum(1, keepdims=True)
        beta = np.ones_like(emit)
        for t in range(len(active) - 2, -1, -1):
            at = head[: active[t + 1]] + t
            ahead = emit[at + 1] * beta[at + 1]
            back = ahead @ step.T
            total = (alpha[at] * back).sum(1, keepdims=True)
            if pairs is not None:
                pairs += (alpha[at].T @ (ahead / total)) * step
            beta[at] = back / back.sum(1, keepdims=True)
        both = alpha * beta
        return both[:, 1] / both.sum(1)

    def document_scores(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean of the lines' P(good), weighted by length, then calibrated."""
        if len(first) < 2:
            return np.zeros(0)
        p = self.marginals(x, first)
        weight = size + 1.0
        mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        return 1.0 / (1.0 + np.exp(-(self.slope * np.log(mean / (1 - mean)) + self.shift)))


def fit_line_model(x: np.ndarray, first: np.ndarray, size: np.ndarray, labels: np.ndarray, rounds: int = 70) -> LineModel:
    """Maximum conditional likelihood with a small ridge, by Adam over the whole sample; every line carries its document's label."""
    if len(labels) == 0 or labels.min() == labels.max():
        share = float((labels.sum() + 0.5) / (len(labels) + 1))
        shift = float(np.log(share / (1 - share)))
        return LineModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)), 0.0, shift)
    mean, spread = x.mean(0), x.std(0)
    mean[-1] = 0.0
    scale = 1.0 / np.where(spread > 1e-9, spread, 1.0)
    z = (x - mean) * scale
    y = np.repeat(labels, np.diff(first)).astype(float)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here - 1].astype(int), y[here].astype(int)), 1.0)
    wanted = z.T @ y
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        model = LineModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
        pairs = np.zeros((2, 2))
        p = model.marginals(x, first, pairs)
        slope = np.concatenate([wanted - z.T @ p, (seen - pairs).ravel()]) / len(y) - 1e-3 * theta
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    model = LineModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    raw = model.document_scores(x, first, size)
    t = np.log(raw / (1 - raw))
    slope, shift = 1.0, 0.0
    for _ in range(25):
        q = 1.0 / (1.0 + np.exp(-np.clip(slope * t + shift, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        g = np.array([(t * (labels - q)).sum() - 0.1 * (slope - 1.0), (labels - q).sum()])
        h = np.array([[(w * t * t).sum() + 0.1, (w * t).sum()], [(w * t).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, shift = slope + float(np.clip(move[0], -1, 1)), shift + float(np.clip(move[1], -2, 2))
    return LineModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), max(slope, 1e-3), shift)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
    sample_lines: int = SAMPLE_LINES,
) -> LineModel:
    """Fit on a bounded sample of labelled documents, the ``sample_docs`` smallest by a hash of the id.

    Rows without an id, label or text are left out; of repeated ids the lowest label and text count. Lines' features
    are made on the executors; the driver gets those of the first documents with ``sample_lines`` lines together.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_label"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            x, first, size = line_features(data, offsets)
            cuts = list(zip(first[:-1].tolist(), first[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"),
                    part.column("_label"),
                    pa.array([x[a:b].astype(np.float32).tobytes() for a, b in cuts]),
                    pa.array([size[a:b].tobytes() for a, b in cuts]),
                    pa.array([b - a for a, b in cuts]),
                ],
                names=["_id", "_label", "x", "size", "lines"],
            )

    made = rows.mapInArrow(features, "_id long, _label int, x binary, size binary, lines long")
    xs, sizes, marks_out, lines, seen = [], [], [], 0, set()
    upto = Window.orderBy(F.xxhash64("_id"), "_id", "lines").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = made.withColumn("_upto", F.sum("lines").over(upto)).where(F.col("_upto") <= sample_lines).drop("_upto")
    for r in made.orderBy(F.xxhash64("_id"), "_id", "lines").toLocalIterator():
        if r["_id"] in seen or lines + r["lines"] > sample_lines:
            continue
        seen.add(r["_id"])
        lines += r["lines"]
        xs.append(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES))
        sizes.append(np.frombuffer(r["size"], np.int64))
        marks_out.append(int(r["_label"] > 0))
    if not xs:
        return fit_line_model(np.zeros((0, FEATURES)), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    return fit_line_model(np.concatenate(xs).astype(np.float64), first, np.concatenate(sizes), np.array(marks_out))


def quality_column(model: LineModel, text: Column) -> Column:
    """The score in 0..1 of each whole text, in Arrow batches; only texts go to Python and only scores come back.

    A null or empty text is one empty line and gets a score as well.
    """

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = utf8(column)
            found = [np.zeros(0)]
            for lo, hi in sub_batches(offsets):
                x, first, size = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found.append(model.document_scores(x, first, size))
            yield pa.array(np.concatenate(found), pa.float64())

    return score(F.coalesce(text, F.lit("")))


def classify_documents(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """Score and prediction of every document; documents with crc32(id) mod ``folds`` = 0 are held out of the fit.

    Repeated rows are scored alike; null ids are hashed as the empty text; with no usable labels every score is
    one half; an empty table gives no rows; extra columns are ignored.
    """
    taught = labels.where(id_bucket(id_col, folds) != 0)
    model = fit_quality(docs, taught, id_col, text_col, sample_docs=sample_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("held_out", id_bucket("doc_id", folds) == 0)
    scored = rows.select("doc_id", "held_out", quality_column(model, F.col("_text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
