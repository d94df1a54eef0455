"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Each of ``TREES`` independent trees branches the documents by the minwise tokens of their shingle sets: a node is a
path of such tokens, and only nodes which are still large branch once more. Small nodes are compared exhaustively:
sketches rule pairs out, full sets confirm the rest. Nodes that stay large at the last level hold sets that are
nearly alike; they are cut into blocks, and members left apart from the node's main class meet all its blocks, in
groups of two blocks each.
Sets of nodes that were branched need to share more tokens, so they get further trees, up to ``ALL_TREES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FIXED_BASE, Scratch, mix64, text_batches, text_of, word_hashes

#: A pair of similarity 0.8 shares the first token of one tree with probability 0.8: 12 trees miss 4 in 10**9 where
#: the nodes of that token are compared as they are.
TREES = 12
DEPTH = 4
SKETCH = TREES * DEPTH
#: Where the shared nodes of a pair were branched, it has to share up to ``DEPTH`` tokens: 40 trees at 0.8**4 miss 7 in 10**10.
ALL_TREES = 40
#: Sketch positions that must agree before sets are compared; at similarity 0.8, fewer occur 2 times in 10**8.
LEAST_AGREEING = 22
#: A node is compared exhaustively up to so many sets, in one task; only larger ones are branched.
LEAF_SETS = 4096
LEAF_SHINGLES = 4 << 20
BLOCK_SETS = 256
BLOCK_SHINGLES = 2 << 20
FIRST_TREES = 2
#: Members of a node that stand so near each other are compared pair by pair, the others by the holders of their shingles.
NEAR_GAPS = 8

_U = np.uint64
_MULTIPLIERS = mix64(np.arange(1, ALL_TREES * DEPTH + 1, dtype=np.uint64) * _U(0x9FB21C651E98DF25)) | _U(1)


# --- sets and sketches


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, base: int = FIXED_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the n+1 bounds of the rows."""
    words, first = word_hashes(data, offsets, base)
    n_words = np.diff(first)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(bounds[-1]) - bounds[row] + first[row]
    size = np.minimum(n_words, width)[row]
    code = size.astype(np.uint64)
    for k in range(width):
        step = (code ^ (code >> _U(29))) * _U(0xBF58476D1CE4E5B9) + words[np.minimum(start + k, len(words) - 1)] if len(words) else code
        code = np.where(k < size, step, code)
    code = mix64(code)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        code[a:b].sort()
    fresh = np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]
    fresh[bounds[:-1][counts > 0]] = True
    return code[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def sketches(code: np.ndarray, bounds: np.ndarray, start: int = 0, stop: int = SKETCH) -> np.ndarray:
    """32-bit minwise values ``start`` to ``stop`` of each row that has shingles; zeros for empty rows."""
    out = np.zeros((len(bounds) - 1, stop - start), np.int32)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        for k in range(start, stop):
            out[filled, k - start] = (np.minimum.reduceat(code * _MULTIPLIERS[k], bounds[filled]) >> _U(32)).astype(np.uint32).view(np.int32)
    return out


def set_digests(code: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes for each row, equal where the sets are equal."""
    halves = np.zeros((len(bounds) - 1, 2), np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        halves[filled, 0] = np.add.reduceat(mix64(code ^ _U(0x5851F42D4C957F2D)), bounds[filled])
        halves[filled, 1] = np.add.reduceat(mix64(code + _U(0x14057B7EF767814F)), bounds[filled])
    return [h.tobytes() for h in halves]


def sign_rows(width: int, base: int = FIXED_BASE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            code, bounds = shingle_sets(data, offsets, width, base)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("pick"),
                    pa.array(np.diff(bounds)),
                    pa.array(set_digests(code, bounds), pa.binary()),
                    _lists(sketches(code, bounds)),
                    _lists(sketches(code, bounds, SKETCH, ALL_TREES * DEPTH)),
                ],
                names=["doc_id", "pick", "n_shingles", "rid", "sketch", "more"],
            )

    return run


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))


def set_rows(width: int, base: int = FIXED_BASE):
    """Sets of the rows whose digest is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            code, bounds = shingle_sets(data, offsets, width, base)
            same = [i for i, (a, b) in enumerate(zip(set_digests(code, bounds), part.column("rid").to_pylist())) if a == b]
            sketch = sketches(code, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("rid").take(pa.array(same, pa.int64())),
                    pa.array([sketch[i].tobytes() for i in same], pa.binary()),
                    pa.array([code[bounds[i] : bounds[i + 1]].tobytes() for i in same], pa.binary()),
                ],
                names=["rid", "marks", "codes"],
            )

    return run


# --- comparing the members of nodes


def node_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by column ``node`` regrouped so that no node is torn: (rows, group bounds)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        if held and node[0] == node[-1] == held[-1].column("node")[0].as_py():
            held.append(batch)
            continue
        cut = len(node) - int(np.argmax((node != node[-1])[::-1])) if node[0] != node[-1] else 0
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield from _bounded(held)
        held = [batch.slice(cut)]
        pa.default_memory_pool().release_unused()
    if held:
        yield from _bounded(held)


def _bounded(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    node = rows.column("node").to_numpy()
    yield rows, np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])


def matrix(column: pa.Array, width: int, kind=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def likely_pairs(sketch: np.ndarray, size: np.ndarray, bounds: np.ndarray, percent: int, last: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of one node whose sketches and sizes allow the similarity, by growing distance in the node, up to ``last``."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(end))
    furthest = int(np.diff(bounds).max()) - 1 if len(end) else 0
    for gap in range(1, (furthest if last is None else min(furthest, last)) + 1):
        at = at[at + gap < end[at]]
        small, large = np.minimum(size[at], size[at + gap]), np.maximum(size[at], size[at + gap])
        i = at[100 * small >= percent * large]
        for lo in range(0, len(i), 1 << 16):
            a = i[lo : lo + (1 << 16)]
            a = a[(sketch[a] == sketch[a + gap]).sum(1) >= LEAST_AGREEING]
            if len(a):
                yield a, a + gap


def active_rows(percent: int):
    """Members of nodes that may be similar to a member of another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in node_groups(batches):
            sketch, size = matrix(rows.column("marks"), SKETCH), rows.column("n_shingles").to_numpy()
            _, klass = np.unique(np.array(rows.column("comp").to_pylist(), dtype="S16"), return_inverse=True)
            chosen = np.zeros(len(size), bool)
            for a, b in likely_pairs(sketch, size, bounds, percent):
                apart = klass[a] != klass[b]
                chosen[a[apart]] = True
                chosen[b[apart]] = True
            yield rows.select(["tree", "node", "rid", "comp"]).filter(pa.array(chosen))

    return run


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


class SharedShingles:
    """The shingles that some sets have in common: each shingle's holders, so that one look gives a set's overlap with all others."""

    def __init__(self, sets: list[np.ndarray]):
        code = np.concatenate(sets)
        order = np.argsort(code, kind="stable")
        code = code[order]
        again = np.zeros(len(code) + 1, bool)
        again[1:-1] = code[1:] == code[:-1]
        shared = again[1:] | again[:-1]  # what one set alone has meets nothing
        self.code = code[shared]
        self.holder = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[order[shared]]
        self.n = len(sets)

    def overlaps(self, one: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``one`` with every set."""
        first = np.searchsorted(self.code, one, "left")
        many = np.searchsorted(self.code, one, "right") - first
        total = int(many.sum())
        place = np.arange(total) + np.repeat(first - np.cumsum(many) + many, many)
        return np.bincount(self.holder[place], minlength=self.n)


def linked_rows(percent: int):
    """Edges between classes that a confirmed pair of full sets joins; pairs of one class need no comparison.

    Neighbours in a node, up to ``NEAR_GAPS`` apart, are compared one by one, which joins most of what is alike. Then each
    member outside the node's largest class is held against all others at once, by the holders of its shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in node_groups(batches):
            sketch = matrix(rows.column("marks"), SKETCH)
            comp = rows.column("comp").to_pylist()
            codes = rows.column("codes")
            sizes = np.array([len(c.as_buffer()) // 8 for c in codes])
            known: dict[bytes, int] = {}
            start = np.array([known.setdefault(c, len(known)) for c in comp])
            parent = list(range(len(known)))
            out: list[tuple[bytes, bytes]] = []
            names = list(known)
            root = start.copy()

            def members(i: int, codes: pa.Array = codes) -> np.ndarray:
                return np.frombuffer(codes[i].as_buffer(), np.uint64)

            for a, b in likely_pairs(sketch, sizes, bounds, percent, NEAR_GAPS):
                apart = root[a] != root[b]
                joined = len(out)
                for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                    x, y = _root(parent, start[i]), _root(parent, start[j])
                    if x == y:
                        continue
                    one, two = members(i), members(j)
                    if len(one) > len(two):
                        one, two = two, one
                    both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        parent[max(x, y)] = min(x, y)
                        out.append((names[x], names[y]))
                if len(out) > joined:
                    root = np.array([_root(parent, k) for k in range(len(parent))])[start]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo > NEAR_GAPS + 1:
                    here = np.array([_root(parent, k) for k in start[lo:hi].tolist()])
                    for x, y in across(here, sketch[lo:hi], sizes[lo:hi], lambda lo=lo, hi=hi: [members(i) for i in range(lo, hi)], percent):
                        parent[max(x, y)] = min(x, y)
                        out.append((names[x], names[y]))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.binary()), pa.array([e[1] for e in out], pa.binary())], names=["a", "b"])

    return run


def across(root: np.ndarray, sketch: np.ndarray, size: np.ndarray, sets: Callable[[], list[np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of classes, given by ``root``, that some pair of one node's sets links; classes joined on the way count as one.

    Members of the largest class are not taken one by one: what they may be linked with outside it looks at them.
    """
    root = root.copy()
    labels, count = np.unique(root, return_counts=True)
    waiting = np.ones(len(root), bool)
    all_sets, index = None, None
    for i in np.flatnonzero(root != labels[np.argmax(count)]).tolist():
        waiting[i] = False
        other = np.flatnonzero(waiting & (root != root[i]))
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        other = other[(sketch[other] == sketch[i]).sum(1) >= LEAST_AGREEING]
        if not len(other):
            continue
        if index is None:
            all_sets = sets()
            index = SharedShingles(all_sets)
        both = index.overlaps(all_sets[i])[other]
        for y in np.unique(root[other[100 * both >= percent * (size[i] + size[other] - both)]]).tolist():
            x = int(root[i])
            yield x, y
            root[(root == x) | (root == y)] = min(x, y)


def by_node(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    return df.repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


# --- connected classes


def contract(scratch: Scratch, edges: DataFrame) -> DataFrame | None:
    """Smallest reachable label of every label on an edge: (v, root). None without edges.

    Every label moves to the smallest label beside it, twice over, and edges move along, until none is left. Labels
    are hashes, so each round merges a constant share of them; rounds are written to the shared folder.
    """
    live = scratch.table(edges.where(F.col("a") != F.col("b")).distinct())
    mapping = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = scratch.table(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
        over = near.select(F.col("v").alias("p"), F.col("p").alias("root"))
        step = scratch.table(near.join(over, "p").select("v", "root"))
        if mapping is None:
            mapping = step
        else:
            ahead = step.select(F.col("v").alias("root"), F.col("root").alias("_next"))
            mapping = scratch.table(mapping.join(ahead, "root", "left").select("v", F.coalesce("_next", "root").alias("root")))
        to_a = step.select(F.col("v").alias("a"), F.col("root").alias("_a"))
        to_b = step.select(F.col("v").alias("b"), F.col("root").alias("_b"))
        moved = live.join(to_a, "a").join(to_b, "b").where("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        live = scratch.table(moved.distinct())
    return mapping


def relabel(scratch: Scratch, moved: DataFrame | None, mapping: DataFrame | None) -> DataFrame | None:
    """Labels (rid, comp) of the sets that are no longer their own class, after one more contraction."""
    if mapping is None or moved is None:
        return moved if mapping is None else scratch.table(mapping.select(F.col("v").alias("rid"), F.col("root").alias("comp")))
    old = moved.join(mapping.select(F.col("v").alias("comp"), "root"), "comp", "left").select("rid", F.coalesce("root", "comp").alias("comp"))
    new = mapping.join(moved, mapping["v"] == moved["rid"], "left_anti").select(F.col("v").alias("rid"), F.col("root").alias("comp"))
    return scratch.table(old.unionByName(new))


# --- the operator


def _paths(sketch: Column, tree: int, first: int) -> list[Column]:
    tokens = [sketch[(tree - first) * DEPTH + d] for d in range(DEPTH)]
    return [F.xxhash64(F.lit(tree), *tokens[: d + 1]).alias(f"p{d + 1}") for d in range(DEPTH)]


def tree_nodes(scratch: Scratch, reps: DataFrame, column: str, trees: range) -> tuple[DataFrame, DataFrame | None]:
    """(tree, node, rid, big, blocks): every set's node in each tree where it is not alone; and the sets whose node was branched, if any.

    ``big`` is the path of a node still large at the last level, else null; its members are dealt to ``blocks``.
    ``column`` has the tokens of ``trees``.
    """
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), *_paths(F.col(column), t, trees.start)) for t in trees])
    paths = reps.select("rid", "n_shingles", F.explode(trees).alias("t")).select("rid", "n_shingles", "t.*")
    columns = ["tree", "node", "rid", "big", "blocks"]

    def counted(rows: DataFrame, level: int) -> DataFrame:
        # the sizes are written first, so that the join is split where one node has very many rows
        path = f"p{level}"
        sizes = rows.groupBy(path).agg(F.count(F.lit(1)).alias("_sets"), F.sum("n_shingles").alias("_load")).where("_sets > 1")
        return scratch.table(rows.drop("_sets", "_load").join(scratch.table(sizes), path))

    here = top = counted(paths, 1)
    out, small = None, (F.col("_sets") <= LEAF_SETS) & (F.col("_load") <= LEAF_SHINGLES)
    for level in range(1, DEPTH + 1):
        done = here.where(small).select("tree", F.col(f"p{level}").alias("node"), "rid", F.lit(None).cast("long").alias("big"), F.lit(1).cast("long").alias("blocks"))
        out = done if out is None else out.unionByName(done)
        rest = here.where(~small)
        if level == 1 and rest.isEmpty():
            return out, None
        if level < DEPTH:
            here = counted(rest, level + 1)
    blocks = F.greatest(F.ceil(F.col("_sets") / BLOCK_SETS), F.ceil(F.col("_load") / BLOCK_SHINGLES)).cast("long")
    last = rest.withColumn("blocks", blocks).withColumn("big", F.col(f"p{DEPTH}"))
    last = last.withColumn("node", block_node(F.col("big"), F.pmod(F.xxhash64("rid", "tree"), F.col("blocks"))))
    return scratch.table(out.unionByName(last.select(*columns))), top.where(~small).select("rid").distinct()


def meetings(torn: DataFrame) -> DataFrame:
    """(tree, node, rid, comp): groups of at most two blocks in which all members of a large node that are of different classes meet.

    ``blocks`` of the node's main class and blocks of its ``_apart`` other members; no group holds two of the former.
    """
    aside = F.col("comp") != F.col("_main")
    others = F.ceil(F.col("_apart") / BLOCK_SETS).cast("long")
    own = F.pmod(F.xxhash64("rid", "tree"), F.when(aside, others).otherwise(F.col("blocks")))
    here = torn.withColumns({"_aside": aside, "_others": others, "_own": own})
    to_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("one"), F.col("_own").alias("two")))
    to_aside = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_others") - 1), lambda b: F.struct((-1 - F.greatest(b, "_own")).alias("one"), F.least(b, "_own").alias("two"))
    )
    from_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_others") - 1), lambda b: F.struct(F.col("_own").alias("one"), b.alias("two")))
    groups = F.when(F.col("_aside"), F.concat(to_main, to_aside)).otherwise(from_main)
    met = here.withColumn("_group", F.explode(groups))
    return met.select("tree", F.xxhash64(F.lit(-2), "big", "_group.one", "_group.two").alias("node"), "rid", "comp")


def block_node(big: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(-1), big, block)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by Jaccard similarity of at least ``percent`` / 100 over ``width``-word shingles.

    Words are runs of bytes other than space, tab, newline, vertical tab, form feed and return, with A-Z in lower
    case; a text of fewer words is one shingle. Returns for every row doc_id, ``pick`` (a hash of id and text),
    n_shingles, ``cluster`` (16 bytes, equal within a class), component_id (the smallest id of the class) and kept
    (the id is component_id). Null, empty and wordless texts have no shingles, are linked with nothing and kept.
    Null ids never are a component_id unless the class has no other; repeated rows fall into one class. Equal sets
    are one vertex from the start, so copies cost no comparisons. Extra columns are ignored.

    Words are compared by 64-bit hashes with fixed bases, those beyond 256 bytes by a polynomial modulo 2**61 - 1. Full
    sets are sets of these hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    # one base for all sessions: what the trees branch on, and so their cost, is the same in each
    base = FIXED_BASE
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("pick"), text.alias("text"))
    signed = scratch.table(
        rows.select("doc_id", "pick", "text").mapInArrow(sign_rows(width, base), "doc_id long, pick long, n_shingles long, rid binary, sketch array<int>, more array<int>")
    )
    reps = scratch.table(
        signed.where("n_shingles > 0")
        .groupBy("rid")
        .agg(F.min("doc_id").alias("least_id"), F.min("pick").alias("pick"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    nodes, branched = tree_nodes(scratch, reps, "sketch", range(TREES))
    # sketches as bytes, so that tasks read them without building lists
    marks = reps.select("rid", "n_shingles", F.to_binary(F.concat_ws("", F.transform("sketch", _little_endian_hex)), F.lit("hex")).alias("marks"))
    node_schema = "tree int, node long, rid binary, comp binary"

    def active(members: DataFrame) -> DataFrame:
        full = members.select("tree", "node", "rid", "comp").join(marks, "rid")
        return scratch.table(by_node(full, active_rows(percent), node_schema))

    def fetch(wanted: DataFrame) -> DataFrame:
        """Sets of the wanted vertices; each is made from one text that has it."""
        keys = wanted.select("rid").distinct().join(reps.select("rid", "pick"), "rid")
        found = rows.select("pick", "text").join(keys, "pick").select("rid", "text")
        return scratch.table(found.mapInArrow(set_rows(width, base), "rid binary, marks binary, codes binary").dropDuplicates(["rid"]))

    def completed(sets: DataFrame, wanted: DataFrame) -> DataFrame:
        missing = wanted.join(sets, "rid", "left_anti")
        return sets if missing.isEmpty() else sets.unionByName(fetch(missing))

    def linked(members: DataFrame, sets: DataFrame) -> DataFrame:
        return by_node(members.join(sets, "rid"), linked_rows(percent), "a binary, b binary")

    def with_class(members: DataFrame, moved: DataFrame | None) -> DataFrame:
        members = members.drop("comp")
        if moved is None:
            return members.withColumn("comp", F.col("rid"))
        return members.join(moved, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))

    def in_torn_nodes(members: DataFrame) -> DataFrame:
        """Members of the nodes that hold more than one class."""
        torn = members.groupBy("node").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a != _b").select("node")
        return members.join(torn, "node", "left_semi")

    chosen = active(with_class(nodes, None))
    sets = fetch(chosen)
    moved = relabel(scratch, None, contract(scratch, linked(chosen.where(F.col("tree") < FIRST_TREES), sets)))
    later = active(in_torn_nodes(with_class(chosen.where(F.col("tree") >= FIRST_TREES), moved)))
    moved = relabel(scratch, moved, contract(scratch, linked(later, sets)))

    if branched is not None:
        keys = branched.join(reps.select("rid", "pick", "n_shingles"), "rid")
        # a row given twice has its pick twice
        more = signed.select("pick", "rid", "more").join(keys, ["pick", "rid"]).dropDuplicates(["pick", "rid"])
        further, _ = tree_nodes(scratch, more, "more", range(TREES, ALL_TREES))
        later = active(in_torn_nodes(with_class(further, moved)))
        sets = completed(sets, later)
        moved = relabel(scratch, moved, contract(scratch, linked(later, sets)))
        nodes = nodes.unionByName(further)

    large = nodes.where(F.col("big").isNotNull())
    if branched is not None and not large.isEmpty():
        members = scratch.table(with_class(large, moved))
        shares = members.groupBy("tree", "big", "comp").agg(F.count(F.lit(1)).alias("_n"))
        most = F.max(F.struct("_n", "comp"))
        main = shares.groupBy("tree", "big").agg(most["comp"].alias("_main"), (F.sum("_n") - most["_n"]).alias("_apart")).where("_apart > 0")
        torn = members.join(scratch.table(main), ["tree", "big"])
        last = active(meetings(torn))
        moved = relabel(scratch, moved, contract(scratch, linked(last, completed(sets, last))))

    vertices = with_class(reps.select("rid", "least_id"), moved)
    least = vertices.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    labels = scratch.table(vertices.join(least, "comp").select("rid", F.col("comp").alias("cluster"), "component_id"))
    scratch.drop_all_but(signed, labels)
    full = signed.where("n_shingles > 0").join(labels, "rid").select("doc_id", "pick", "n_shingles", "cluster", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "pick", "n_shingles", F.lit(None).cast("binary").alias("cluster"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _little_endian_hex(x: Column) -> Column:
    """Eight hex digits of a 32-bit integer, lowest byte first."""
    digits = F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.concat(F.substring(digits, 7, 2), F.substring(digits, 5, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2))


def keep_one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one row of each class in ``found``; rows without shingles all stay."""
    stay = found.where("kept AND n_shingles > 0").groupBy("cluster").agg(F.min("pick").alias("_pick"))
    copies = found.where("n_shingles > 0").groupBy(F.col("pick").alias("_pick")).agg(F.count(F.lit(1)).alias("_copies"))
    stay = stay.join(copies, "_pick").select("_pick", "_copies")
    bare = found.where("n_shingles = 0").select(F.col("pick").alias("_pick"), F.lit(1).cast("long").alias("_copies")).distinct()
    keys = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.col(id_col).cast("long"), text_of(text_col)).alias("_pick"))
    kept = keys.join(stay.unionByName(bare), "_pick")
    once, more = kept.where("_copies = 1"), kept.where("_copies > 1").dropDuplicates(["_pick"])
    return once.unionByName(more).select("_row.*")
