"""Links inside one node of the near-duplicate trees, held against all pairs of sets."""

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm.near_dup import SKETCH, SharedShingles, linked_rows, sketches


def _sets(seed: int, n: int, keep: float) -> list[np.ndarray]:
    """Sets made from a few templates, of which each member replaces some shingles by others, often the same ones."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(1, 1 << 62, 4000)).astype(np.uint64)
    templates = [rng.choice(pool, 120, replace=False) for _ in range(3)]
    out = []
    for _ in range(n):
        base = templates[rng.integers(0, 3)]
        stay = base[rng.random(len(base)) < rng.uniform(keep, 1)]
        out.append(np.unique(np.concatenate([stay, rng.choice(pool, len(base) - len(stay))])))
    return out


def _classes(n: int, edges) -> list[int]:
    least = list(range(n))
    for _ in range(n):
        before = list(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least
    return least


def _rows(sets: list[np.ndarray], nodes: list[int], names: list[int]) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    marks = sketches(np.concatenate(sets), bounds, 0, SKETCH)
    columns = [
        pa.array(nodes, pa.int64()),
        pa.array([k.to_bytes(16, "big") for k in names], pa.binary()),
        pa.array([m.tobytes() for m in marks], pa.binary()),
        pa.array([s.tobytes() for s in sets], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["node", "comp", "marks", "codes"])


def _edges(rows: pa.RecordBatch) -> list[tuple[int, int]]:
    return [tuple(int.from_bytes(v, "big") for v in pair) for out in linked_rows(80)(iter([rows])) for pair in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]


def _linked(one: np.ndarray, two: np.ndarray) -> bool:
    both = len(np.intersect1d(one, two))
    return 100 * both >= 80 * (len(one) + len(two) - both)


@pytest.mark.parametrize("seed,n,keep", [(1, 150, 0.6), (2, 150, 0.85), (3, 150, 0.3), (4, 11, 0.8), (5, 2, 0.95)])
def test_links_of_a_node_are_those_of_all_pairs(seed, n, keep):
    sets = _sets(seed, n, keep)
    want = [(i, j) for i in range(n) for j in range(i) if _linked(sets[i], sets[j])]
    assert _classes(n, _edges(_rows(sets, [7] * n, list(range(n))))) == _classes(n, want)


def test_nodes_in_one_batch_stay_apart_and_share_their_classes():
    sets = _sets(6, 60, 0.7)
    nodes = [1] * 60 + [2] * 60
    # the second node holds the same sets under other names, all of them of one class but for the last
    names = list(range(60)) + [100] * 59 + [101]
    got = _edges(_rows(sets + sets, nodes, names))
    want = [(i, j) for i in range(60) for j in range(i) if _linked(sets[i], sets[j])]
    first = [(a, b) for a, b in got if a < 60]
    assert _classes(60, first) == _classes(60, want) and all(b < 60 for _, b in first)
    last = any(_linked(sets[59], s) for s in sets[:59])
    assert [(a, b) for a, b in got if a >= 60 or b >= 60] in ([[(101, 100)], [(100, 101)]] if last else [[]])


def test_sets_of_exactly_the_similarity_are_linked_and_just_below_are_not():
    rng = np.random.default_rng(9)
    fresh = iter(np.unique(rng.integers(1, 1 << 62, 20000)).astype(np.uint64).tolist())
    core = [next(fresh) for _ in range(80)]

    def member(of: list[int], own: int) -> np.ndarray:
        return np.array(sorted(of + [next(fresh) for _ in range(own)]), np.uint64)

    # intersection 80 of union 100 (exactly 0.8), then 80 of 101; far from each other in the node
    sets = [member(core, 10)] + [member([], 90) for _ in range(30)] + [member(core, 10)] + [member([], 90) for _ in range(30)] + [member(core, 11)]
    got = {frozenset(e) for e in _edges(_rows(sets, [7] * len(sets), list(range(len(sets)))))}
    assert got == {frozenset((0, 31))}


def test_overlaps_count_shared_shingles_only_once_a_set():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [3])]
    index = SharedShingles(sets)
    assert [index.overlaps(s).tolist() for s in sets[:2]] == [[2, 2, 0, 1], [2, 2, 0, 1]]
    assert index.overlaps(sets[2]).tolist() == [0, 0, 0, 0]
