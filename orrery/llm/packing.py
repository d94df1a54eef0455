"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_batches, text_of
from .pieces import bare_pieces, piece_memory

DEFAULT_TOKENIZER = "word_bpe_49k.json"

def piece_rows(tokenizer: str, capacity: int, end_id: int):
    """A function for mapInArrow: documents to their pieces, ranked among the task's pieces of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = piece_memory(tokenizer, True)
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for rows, data, offsets in text_batches(batches):
            starts, ends, first = bare_pieces(data, offsets)
            size, begin = memory.look_up(data, starts, ends)
            ids = memory.all_ids(size, begin)
            bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[first]
            out: dict[str, list] = defaultdict(list)
            doc_ids = rows.column("doc_id").to_pylist()
            for doc, lo, hi in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist()):
                whole = ids[lo:hi].astype("<u4").tobytes() + end
                for k, a in enumerate(range(0, len(whole), 4 * capacity)):
                    cut = whole[a : a + 4 * capacity]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(a // 4)
                    out["length"].append(len(cut) // 4)
                    out["ids_crc32"].append(zlib.crc32(cut))
            length = np.array(out["length"], np.int64)
            order = np.argsort(length, kind="stable")
            runs = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(runs)) - np.searchsorted(runs, runs) + seen[runs]
            seen += np.bincount(length, minlength=capacity + 1)
            n = len(length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()),
                    pa.array(out["piece"], pa.int32()),
                    pa.array(out["start"], pa.int64()),
                    pa.array(length),
                    pa.array(out["ids_crc32"], pa.int64()),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(rank),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return run


class CapacityTree:
    """Segment tree over remaining capacities: finds the smallest one in use that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.size)

    def set(self, capacity: int, used: bool) -> None:
        at = self.size + capacity
        self.used[at] = used
        while at > 1:
            at >>= 1
            self.used[at] = self.used[2 * at] | self.used[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = self.size + least
        if self.used[at]:
            return least
        while at > 1:
            if not at & 1 and self.used[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths, exactly as over single pieces.

    Equal pieces are placed together: bins with the same remaining capacity are ranges of bin numbers, and the
    tightest range that fits takes as many of them as each of its bins can hold. Returns rows (length, first rank,
    ranks, first bin, offset): ranks [first, first + ranks) go to consecutive bins at that offset. Their number
    depends on the capacity alone, not on the number of documents.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    tree = CapacityTree(capacity)
    bins = 0

    def put(left: int, first: int, count: int) -> None:
        if count and left:
            open_bins[left].append((first, count))
            tree.set(left, True)

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        rank, left_over = 0, histogram[length]
        while left_over:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = bins, -(-left_over // each)
                bins += count
            else:
                each = room // length
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            full = min(count, left_over // each)
            for k in range(each if full else 0):
                plan.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left_over -= full * each
            put(room - each * length, first, full)
            first, count = first + full, count - full
            if count and left_over:
                for k in range(left_over):
                    plan.append((length, rank, 1, first, capacity - room + k * length))
                    rank += 1
                put(room - left_over * length, first, 1)
                first, count, left_over = first + 1, count - 1, 0
            put(room, first, count)
    return plan


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's token pieces with the sequence and the offset where each one lies.

    A document is its ids followed by ``end_id``; only one longer than ``capacity`` is cut. A null or empty text is
    the end id alone; repeated rows are packed each on its own; null ids and extra columns do no harm; an empty
    table gives no rows. Best-fit decreasing sees lengths alone, so it runs over the histogram of lengths, at most
    ``capacity`` numbers, and each piece then finds its place by its rank among pieces of the same length. Ranks
    come from counts by task, so no task and not the driver sees all pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    pieces = scratch.table(rows.mapInArrow(piece_rows(tokenizer, capacity, end_id), schema))
    by_part = scratch.table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("pieces")))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    plan = np.array(best_fit_plan(histogram, capacity), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    first_row = np.searchsorted(plan[:, 0], np.arange(capacity + 2))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("earlier"))
    # starts has a row for each task and length: it grows with the table and is never broadcast
    ranked = pieces.join(starts.hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = plan[:, 1].max() + 1 if len(plan) else 1
        sorted_key = plan[:, 0] * width + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(sorted_key, length * width + np.minimum(rank, width - 1), side="right") - 1
            assert (at >= first_row[length]).all() and (rank - plan[at, 1] < plan[at, 2]).all()
            sequence = plan[at, 3] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(plan[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
