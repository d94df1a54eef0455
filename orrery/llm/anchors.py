"""Content-chosen anchors: every window of a text belongs to one of its byte grams, the same wherever it stands."""

from __future__ import annotations

import numpy as np

from .common import FIXED_BASE, RangeCode, prefix_code, range_hash

GRAM = 32
#: Windows of one run at most; where a longer run is cut changes no result.
RUN_WINDOWS = 8192
#: Bases of the two hashes by which runs are told apart, where none are given.
BASES = (FIXED_BASE, FIXED_BASE // 3)
_POSITION_BITS = 26
_POSITION = np.uint64((1 << _POSITION_BITS) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width`` values, from running minima of blocks to the left and to the right."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, offsets: np.ndarray, window: int, bases: tuple[int, int] = BASES) -> dict[str, np.ndarray]:
    """Runs of consecutive windows of ``window`` bytes whose anchors are the same gram, never across rows.

    Arrays ``row``, ``lo`` (first window's place in ``data``), ``n`` (windows), ``spots`` (places of the gram that are
    an anchor), ``anchor`` (hash of the gram), ``digest`` and ``twin`` (two hashes of all bytes of the run's windows).
    Equal windows have the same anchor at the same distance; text of one repeated pattern is one run.
    """
    gram = min(GRAM, window)
    names = ("row", "lo", "n", "spots", "anchor", "digest", "twin")
    empty = {k: np.zeros(0, np.uint64 if k in ("anchor", "digest", "twin") else np.int64) for k in names}
    if len(data) < window:
        return empty
    assert len(data) <= int(_POSITION)
    prefix = prefix_code(data)
    at = np.arange(len(data) - gram + 1)
    grams = range_hash(prefix, at, at + gram)
    owner = (sliding_least((grams & ~_POSITION) | at.astype(np.uint64), window - gram + 1) & _POSITION).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(owner)]
    windows = np.flatnonzero(at[: len(owner)] + window <= offsets[1:][row])
    if not len(windows):
        return empty
    owner, row = owner[windows], row[windows]
    moved = np.ones(len(windows), bool)
    moved[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    fresh = moved.copy()
    fresh[1:] &= (grams[owner[1:]] != grams[owner[:-1]]) | (row[1:] != row[:-1])
    since = np.arange(len(windows)) - np.maximum.accumulate(np.where(fresh, np.arange(len(windows)), 0))
    fresh |= since % RUN_WINDOWS == 0
    first = np.flatnonzero(fresh)
    lo = windows[first]
    n = np.diff(np.append(first, len(windows)))
    end = lo + n - 1 + window
    spots = np.add.reduceat((moved | fresh).astype(np.int64), first)
    return {"row": row[first], "lo": lo, "n": n, "spots": spots, "anchor": grams[owner[first]], "digest": RangeCode(data, bases[0]).hashes(lo, end), "twin": RangeCode(data, bases[1]).hashes(lo, end)}


def block_runs(data: np.ndarray, ends: np.ndarray, anchor: np.ndarray, window: int, width: int, bases: tuple[int, int] = BASES) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Blocks of the windows of whole runs: those whose anchor lies ``width`` * b to ``width`` * (b + 1) - 1 bytes in.

    All windows of a block share its core, the bytes that each of them holds. Arrays ``run``, ``a`` and ``b`` (windows
    of the run, of the first such block in it), ``places`` (such blocks in the run), ``key`` (hash of anchor, distance
    and core; equal windows have equal keys), and two hashes of all the block's bytes. The second result has ``run``,
    ``a`` and ``b`` of the stretches of blocks that a run holds more than once.
    """
    gram = min(GRAM, window)
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data))
    stop = ends[1:][owner]
    prefix = prefix_code(data)
    whole = np.flatnonzero(at + gram <= stop)
    hit = whole[range_hash(prefix, whole, whole + gram) == anchor[owner[whole]]]
    w = np.flatnonzero(at + window <= stop)
    place = hit[np.searchsorted(hit, w)]
    block, run = (place - w) // width, owner[w]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(fresh)
    lo, hi = w[first], np.append(w[first[1:] - 1], w[-1:]) + 1
    run, place, block = run[first], place[first], block[first]
    core = place - width * block
    code = range_hash(prefix, core, core + window - width + 1)
    step = np.uint64(width << 32) + block.astype(np.uint64)
    key = code ^ ((anchor[run] + step) * np.uint64(0x9FB21C651E98DF25))
    digest, twin = (RangeCode(data, b).hashes(lo, hi + window - 1) for b in bases)
    order = np.lexsort((twin, digest, key, run))
    fresh = np.ones(len(run), bool)
    fresh[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (run, key, digest, twin)], axis=0)
    kinds = np.flatnonzero(fresh)
    places = np.diff(np.append(kinds, len(run)))
    often = np.zeros(len(run), bool)
    often[order] = np.repeat(places > 1, places)
    base = ends[:-1]
    first = order[kinds]
    out = {"run": run[first], "a": lo[first] - base[run[first]], "b": hi[first] - base[run[first]], "places": places, "key": key[first], "digest": digest[first], "twin": twin[first]}
    run, lo, hi = run[often], lo[often], hi[often]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (lo[1:] != hi[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(run)) - 1
    again = {"run": run[first], "a": lo[first] - base[run[first]], "b": hi[last] - base[run[first]]} if len(run) else {k: np.zeros(0, np.int64) for k in ("run", "a", "b")}
    return out, again
