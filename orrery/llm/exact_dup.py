"""Removal of long byte strings that occur more than once, by suffix arrays over shards of the candidates.

Every window of ``window`` bytes belongs to one anchor gram of its own content, so equal windows meet under equal
anchors. Windows of anchors that occur once are unique; runs of windows that are alike as a whole are one entry with
a count. What remains goes, anchor by anchor, to shards with a suffix array each. The runs of an anchor that would not
fit one shard (a passage in very many documents) are cut into blocks of windows which share all but a few bytes, ever
finer: blocks seen once or alike everywhere are settled, the others meet by what they share. Blocks of the last level
that still do not fit one shard go to several, whose sorted windows are merged by binary search.

Runs and blocks are taken for alike when two hashes of all their bytes agree, polynomials modulo 2**61 - 1 whose bases
are drawn for each application: strings of 8,192 windows that differ agree with probability 2**-94.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BASES, block_runs, window_runs
from .common import Scratch, hash_bases, text_batches, text_of
from .near_dup import node_groups
from .suffix import common_prefixes, repeat_classes, suffix_array

WINDOW = 400
#: Bytes of one suffix array, and of the groups of runs that are never divided among arrays.
SHARD_BYTES = 1 << 19
GROUP_BYTES = 1 << 18
#: Windows of a block, level by level, where an anchor's runs do not fit one shard.
BLOCKS = (64, 16, 4)
#: Bytes of one text looked at together; a longer text is read in overlapping stretches.
STRETCH = 1 << 19
#: What tells runs apart.
RUN = ["anchor", "digest", "twin", "n"]
RUN_SCHEMA = "anchor long, digest long, twin long, n int"


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def anchor_rows(window: int, bases: tuple[int, int] = BASES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_batches(batches):
            pick = rows.column("pick").to_numpy()
            for base in range(0, max(len(data), 1), STRETCH) if rows.num_rows == 1 else (0,):
                whole = rows.num_rows > 1
                part = data if whole else data[base : base + STRETCH + window - 1]
                bounds = offsets if whole else np.array([0, len(part)])
                found = window_runs(part, bounds, window, bases)
                row = found["row"].astype(np.int64)
                columns = [_longs(found[k]) for k in ("anchor", "digest", "twin")]
                columns += [pa.array(found[k].astype(np.int32)) for k in ("n", "spots")]
                columns += [pa.array(pick[row]), _longs(found["lo"] - bounds[row] + base)]
                yield pa.RecordBatch.from_arrays(columns, names=[*RUN, "spots", "pick", "lo"])

    return run


def run_bytes(window: int):
    """Bytes of the wanted runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_batches(batches):
            raw = data.tobytes()
            wanted = rows.column("wanted")
            counts = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            lo = flat.field("lo").to_numpy() + np.repeat(offsets[:-1], counts)
            hi = lo + flat.field("n").to_numpy() + window - 1
            names = [*RUN, "copies", "fits"]
            bodies = pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in names), bodies], names=[*names, "body"])

    return run


def block_rows(window: int, width: int, bases: tuple[int, int] = BASES):
    """The blocks of ``width`` windows within the given slices of runs; stretches that repeat within one run have no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_batches(batches, "body"):
            found, again = block_runs(data, offsets, rows.column("anchor").to_numpy().view(np.uint64), window, width, bases)
            copies = rows.column("copies").to_numpy()
            hashes = {k: _longs(found[c]) for k, c in (("key", "key"), ("one", "digest"), ("two", "twin"))}
            yield _block_batch(rows, found, hashes | {"places": _longs(found["places"] * copies[found["run"]])})
            none = {k: pa.nulls(len(again["run"]), pa.int64()) for k in ("key", "one", "two", "places")}
            yield _block_batch(rows, again, none)

    return run


def _block_batch(rows: pa.RecordBatch, found: dict[str, np.ndarray], more: dict[str, pa.Array]) -> pa.RecordBatch:
    take, shift = pa.array(found["run"]), rows.column("a").to_numpy()[found["run"]]
    columns = [rows.column(k).take(take) for k in [*RUN, "copies"]]
    columns += [*more.values(), *(pa.array((found[k] + shift).astype(np.int32)) for k in ("a", "b"))]
    return pa.RecordBatch.from_arrays(columns, names=[*RUN, "copies", *more, "a", "b"])


def _shards(rows: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole groups together, up to SHARD_BYTES; runs that came twice only once."""
    sizes = np.array([len(b.as_buffer()) for b in rows.column("body")], np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SHARD_BYTES, side="right")) - 1)
        some = rows.slice(bounds[lo], bounds[hi] - bounds[lo])
        keys = np.stack([some.column(k).to_numpy().astype(np.int64) for k in ("node", *RUN, "a")], 1)
        _, first = np.unique(keys, axis=0, return_index=True)
        yield some.take(pa.array(np.sort(first)))
        lo = hi


def shard_rows(window: int):
    """Repeated windows of each shard, as ranges of their runs; of split groups also the windows unique here and one of each class, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in node_groups(batches):
            for rows in _shards(group, bounds):
                bodies = [b.as_buffer() for b in rows.column("body")]
                raw = b"".join(bodies)
                data = np.frombuffer(raw, np.uint8)
                end = np.cumsum([len(b) for b in bodies])
                start = np.concatenate([[0], end[:-1]])
                owner = np.repeat(np.arange(len(end)), end - start)
                ends = end[owner]
                order = suffix_array(data, ends)
                shared = common_prefixes(data, ends, order, window)
                klass = np.empty(len(data), np.int64)
                klass[order] = repeat_classes(shared[order], window)
                is_window = np.arange(len(data)) + window <= ends
                weight = np.where(is_window, rows.column("copies").to_numpy()[owner], 0)
                places = np.bincount(klass, weights=weight)
                repeated = is_window & (places[klass] > 1)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
                # a range of repeated windows never crosses bodies: the bytes after a body's last window are none
                lo, hi = edge[::2], edge[1::2]
                none = pa.nulls(len(lo), pa.binary())
                yield _ranges(rows, owner[lo] if len(lo) else lo, lo, hi, start, np.zeros(len(lo), bool), none)
                split = rows.column("split").to_numpy(zero_copy_only=False)
                if split.any():
                    at = np.flatnonzero(is_window & split[owner])
                    _, first = np.unique(klass[at], return_index=True)
                    keep = np.zeros(len(data), bool)
                    keep[at[first]] = True
                    keep[at[~repeated[at]]] = True
                    at = order[keep[order]]
                    windows = pa.array([raw[p : p + window] for p in at.tolist()], pa.binary())
                    yield _ranges(rows, owner[at], at, at + 1, start, np.ones(len(at), bool), windows)

    return run


def _ranges(rows: pa.RecordBatch, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, open_: np.ndarray, windows: pa.Array) -> pa.RecordBatch:
    take = pa.array(owner.astype(np.int64))
    shift = rows.column("a").to_numpy()[owner] - start[owner]
    columns = [rows.column(k).take(take) for k in [*RUN, "node", "parts"]]
    columns += [pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)), pa.array(open_), windows]
    return pa.RecordBatch.from_arrays(columns, names=[*RUN, "shard", "parts", "a", "b", "open", "window"])


def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of split groups that another shard has too: each window is searched in the sorted windows of the shards before."""
    for rows, bounds in node_groups(batches):
        windows, shard = rows.column("window").to_pylist(), rows.column("shard").to_numpy()
        chosen = np.zeros(len(windows), bool)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            seen: list[bytes] = []
            twice: set[bytes] = set()
            for one in np.unique(shard[lo:hi]):
                mine = sorted({windows[lo + k] for k in np.flatnonzero(shard[lo:hi] == one).tolist()})
                fresh = []
                for w in mine:
                    at = bisect_left(seen, w)
                    if at < len(seen) and seen[at] == w:
                        twice.add(w)
                    else:
                        fresh.append(w)
                seen = sorted(seen + fresh)
            chosen[lo:hi] = [w in twice for w in windows[lo:hi]]
        yield rows.select([*RUN, "a", "b"]).filter(pa.array(chosen))


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pick, spans): for each text with repeated windows, the byte ranges that they cover.

    ``pick`` is a hash of id and text, as ``row_key`` makes it. Ranges may overlap.
    """
    scratch = Scratch(docs.sparkSession, "exact-dup")
    rows = docs.select(row_key(id_col, text_col), text_of(text_col).alias("text"))
    occurrences = scratch.table(rows.mapInArrow(anchor_rows(window, hash_bases(docs.sparkSession)), f"{RUN_SCHEMA}, spots int, pick long, lo long"))
    # tables of counts are written first, so that joins with them are split where one anchor has very many rows
    common = scratch.table(occurrences.groupBy("anchor").agg(F.sum("spots").alias("_places")).where("_places > 1").select("anchor"))
    found = scratch.table(occurrences.join(common, "anchor"))
    scratch.drop(occurrences, common)
    runs = scratch.table(found.groupBy(*RUN).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("pick", "lo")).alias("at")))
    load = F.sum(F.col("n") + (window - 1))
    groups = scratch.table(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), load.alias("load")))
    runs = scratch.table(runs.join(groups, "anchor"))
    alike = (F.col("kinds") == 1) & (F.col("copies") > 1)
    mixed = runs.where(~alike).select(
        F.col("at.pick").alias("pick"), F.struct(*RUN, "copies", (F.col("load") <= GROUP_BYTES).alias("fits"), F.col("at.lo").alias("lo")).alias("run")
    )
    wanted = mixed.groupBy("pick").agg(F.collect_list("run").alias("wanted"))
    bodies = scratch.table(rows.join(wanted, "pick").select("text", "wanted").mapInArrow(run_bytes(window), f"{RUN_SCHEMA}, copies long, fits boolean, body binary"))
    whole, shards = [runs.where(alike).select(*RUN, F.lit(0).alias("a"), F.col("n").alias("b"))], []
    small = bodies.where("fits").withColumn("node", F.xxhash64("anchor")).withColumns({"split": F.lit(False), "parts": F.lit(1).cast("long"), "a": F.lit(0)})
    shards.append(small)
    slices = bodies.where("NOT fits").dropDuplicates(RUN).select(*RUN, "copies", F.lit(0).alias("a"), F.col("n").alias("b"))
    if not slices.isEmpty():
        bodies = scratch.table(bodies.where("NOT fits").dropDuplicates(RUN).select(*RUN, "body"))
        slices = scratch.table(slices)
        settled, open_ = _by_blocks(scratch, slices, bodies, window)
        whole += settled
        shards += open_
    every = shards[0]
    for more in shards[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    every = every.select("node", "split", "parts", *RUN, "copies", "a", "body").repartition("node").sortWithinPartitions("node")
    judged = scratch.table(every.mapInArrow(shard_rows(window), f"{RUN_SCHEMA}, shard long, parts long, a int, b int, open boolean, window binary"))
    part = F.xxhash64("anchor", F.pmod(F.xxhash64("window"), F.col("parts")))
    pending = judged.where("open").withColumn("node", part).select("node", *RUN, "shard", "a", "b", "window").repartition("node").sortWithinPartitions("node")
    merged = scratch.table(pending.mapInArrow(merged_rows, f"{RUN_SCHEMA}, a int, b int"))
    repeated = judged.where("NOT open").select(*RUN, "a", "b").unionByName(merged)
    for more in whole:
        repeated = repeated.unionByName(more)
    spans = found.select(*RUN, "pick", "lo").join(repeated, RUN).select(
        "pick", F.struct((F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b") + (window - 1)).alias("hi")).alias("span")
    )
    out = scratch.table(spans.groupBy("pick").agg(F.collect_set("span").alias("spans")))
    scratch.drop_all_but(out)
    return out


def _with_bytes(slices: DataFrame, bodies: DataFrame, window: int) -> DataFrame:
    """Slices of runs, windows ``a`` to ``b``, with the bytes of those windows."""
    return slices.join(bodies, RUN).withColumn("body", F.substring("body", F.col("a") + 1, F.col("b") - F.col("a") + (window - 1)))


def _by_blocks(scratch: Scratch, slices: DataFrame, bodies: DataFrame, window: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of runs whose anchor does not fit one shard: ranges that are repeated as a whole, and slices for shards.

    The rows of each level come from single runs, not from whole anchors, and its counts are summed before they are
    shuffled: a frequent anchor is spread over all tasks. Each level keeps only what its blocks leave undecided, at
    most a few blocks at the edges of what a frequent passage shares.
    """
    settled, shards = [], []
    for width in [w for w in BLOCKS if 4 * w <= window]:
        made = _with_bytes(slices, bodies, window).mapInArrow(
            block_rows(window, width, hash_bases(scratch.spark)), f"{RUN_SCHEMA}, copies long, key long, one long, two long, places long, a int, b int"
        )
        blocks = scratch.table(made)
        alike = (F.min("one") == F.max("one")) & (F.min("two") == F.max("two"))
        load = F.sum(F.col("b") - F.col("a") + (window - 1))
        settled.append(blocks.where("key IS NULL").select(*RUN, "a", "b"))
        groups = blocks.where("key IS NOT NULL").groupBy("key").agg(F.sum("places").alias("_places"), alike.alias("_alike"), load.alias("_load")).where("_places > 1")
        joined = scratch.table(blocks.join(scratch.table(groups), "key").select(*RUN, "copies", "key", "a", "b", "_alike", "_load"))
        settled.append(joined.where("_alike").select(*RUN, "a", "b"))
        fits = joined.where(~F.col("_alike") & (F.col("_load") <= GROUP_BYTES))
        shards.append(_with_bytes(fits, bodies, window).select(F.col("key").alias("node"), F.lit(False).alias("split"), F.lit(1).cast("long").alias("parts"), *RUN, "copies", "a", "body"))
        slices = joined.where(~F.col("_alike") & (F.col("_load") > GROUP_BYTES))
        if slices.isEmpty():
            return settled, shards
    if "key" not in slices.columns:  # the window is too short for blocks
        sizes = scratch.table(slices.groupBy("anchor").agg(F.sum(F.col("b") - F.col("a") + (window - 1)).alias("_load")))
        slices = slices.join(sizes, "anchor").withColumn("key", F.col("anchor"))
    parts = F.ceil(F.col("_load") / GROUP_BYTES)
    node = F.xxhash64("key", F.pmod(F.xxhash64("digest", "twin", "n", "a"), parts))
    shards.append(_with_bytes(slices, bodies, window).select(node.alias("node"), F.lit(True).alias("split"), parts.alias("parts"), *RUN, "copies", "a", "body"))
    return settled, shards


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), text_of(text_col)).alias("pick")


def _merged(spans: pa.Array) -> np.ndarray:
    """Disjoint sorted ranges of possibly overlapping ones."""
    lo, hi = spans.field("lo").to_numpy(), spans.field("hi").to_numpy()
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
    return np.stack([lo[fresh], reach[np.append(fresh[1:] - 1, len(lo) - 1)]], 1)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False
) -> DataFrame:
    """Every row with the bytes left after each byte covered by a repeated ``window``-byte string is removed.

    All places of such a string are removed, the first as well; overlapping places count, places are judged on the
    input, and strings never cross documents. Returns the columns ``keep`` (the id by default), n_bytes, n_removed,
    n_spans (maximal removed ranges), kept_sha256 (hex) and ``kept_bytes`` (binary; characters may be cut) or, with
    ``as_text``, ``kept_text`` (string, without the parts of characters that a cut left). Null and
    empty texts have no bytes; texts shorter than the window keep all; repeated rows of ``window`` bytes or more
    lose everything; null ids and extra columns do no harm; an empty table gives no rows.
    """
    names = [id_col] if keep is None else keep
    spans = repeated_windows(docs, window, id_col, text_col)
    rows = docs.select(row_key(id_col, text_col), text_of(text_col).alias("text"), F.struct(*names).alias("_row"))
    joined = rows.join(spans, "pick", "left").select("_row", "text", F.coalesce("spans", F.expr("array()")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            raw = data.tobytes()
            bounds = part.column("spans").offsets.to_numpy()
            flat = part.column("spans").flatten()
            removed, counts, digests, left = [], [], [], []
            for k in range(part.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                cuts = _merged(flat.slice(bounds[k] - bounds[0], bounds[k + 1] - bounds[k])).tolist() if bounds[k + 1] > bounds[k] else []
                at, pieces = 0, []
                for lo, hi in cuts:
                    pieces.append(text[at:lo])
                    at = hi
                body = b"".join([*pieces, text[at:]])
                removed.append(len(text) - len(body))
                counts.append(len(cuts))
                digests.append(hashlib.sha256(body).hexdigest())
                left.append(body.decode("utf-8", "ignore") if as_text else body)
            columns = [part.column("_row"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept])

    kept = "kept_text" if as_text else "kept_bytes"
    kind = joined.schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {kept} {'string' if as_text else 'binary'}"
    return joined.mapInArrow(run, schema).select("_row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept)
