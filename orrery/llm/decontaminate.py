"""Benchmark decontamination by pigeonhole piece hits and bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Share of an item's characters that may be edited.
ERROR_RATE = 0.1
#: Items of fewer characters must occur as they are, between word boundaries.
EDITABLE_CHARS = 32
#: Characters of items that one scan of the documents looks for; a larger benchmark takes several scans.
BLOCK_CHARS = 4 << 20


def normalized(text: str) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join(text.lower().split())


def search_distance(masks: dict[str, int], size: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern to a substring of ``text``, and the first end of such a substring.

    Myers' bit-parallel columns; ``masks`` has for each character the pattern's positions as bits. With ``anchored``
    the substring must begin where ``text`` does.
    """
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, char in enumerate(text, 1):
        equal = masks.get(char, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1) | anchored
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, at
    return best, end


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | (1 << k)
    return masks


def within_one(pattern: str, text: str) -> bool:
    """Whether a start of ``text`` is at most one edit from ``pattern``."""
    n = len(pattern)
    if text.startswith(pattern):
        return True
    k = next((i for i, (a, b) in enumerate(zip(pattern, text)) if a != b), min(n, len(text)))
    rest = pattern[k + 1 :]
    return rest == text[k + 1 : n] or rest == text[k : n - 1] or pattern[k:] == text[k + 1 : n + 1]


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int
    cuts: tuple[int, ...]

    @classmethod
    def of(cls, item_id: int, text: str, rate: float) -> Item:
        budget = int(rate * len(text)) if len(text) >= EDITABLE_CHARS else 0
        return cls(item_id, text, budget, tuple(len(text) * k // (budget + 1) for k in range(budget + 2)))


class Matcher:
    """Finds items within their error budget: an occurrence leaves one of budget + 1 pieces as it is."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for k in range(item.budget + 1):
                pieces.setdefault(item.text[item.cuts[k] : item.cuts[k + 1]], []).append((i, k))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def _pair_fits(self, item: Item, k: int, text: str, lo: int, hi: int) -> bool:
        """Whether the piece's partner, the other of pieces 2j and 2j+1, follows or precedes with at most one edit.

        If every pair held two edits or more and a lone last piece one, the budget would be exceeded.
        """
        if k % 2 == 0:
            if k == item.budget:
                return True
            other = item.text[item.cuts[k + 1] : item.cuts[k + 2]]
            return within_one(other, text[hi : hi + len(other) + 1])
        other = item.text[item.cuts[k - 1] : item.cuts[k]]
        return within_one(other[::-1], text[max(0, lo - len(other) - 1) : lo][::-1])

    def _verify(self, i: int, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        item = self.items[i]
        if len(item.text) < EDITABLE_CHARS:
            return None if text[lo - 1 : lo].isalnum() or text[hi : hi + 1].isalnum() else (0, lo, hi)
        if i not in self.masks:
            self.masks[i] = bit_masks(item.text), bit_masks(item.text[::-1])
        ahead, behind = self.masks[i]
        size = len(item.text)
        distance, end = search_distance(ahead, size, text[lo:hi])
        if distance > item.budget:
            return None
        end += lo
        _, length = search_distance(behind, size, text[max(0, end - size - distance) : end][::-1], anchored=True)
        return distance, end - length, end

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Best (distance, start, end) in the normalized text for each item that it holds."""
        found: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for last, places in self.automaton.iter(text):
            for i, k in places:
                item = self.items[i]
                hi = last + 1
                lo = hi - (item.cuts[k + 1] - item.cuts[k])
                begin = lo - item.cuts[k]
                spot = (i, begin)
                if spot in done or found.get(i, (1,))[0] == 0 or not self._pair_fits(item, k, text, lo, hi):
                    continue
                done.add(spot)
                hit = self._verify(i, text, max(0, begin - item.budget), begin + len(item.text) + item.budget)
                if hit and (i not in found or hit < found[i]):
                    found[i] = hit
        return found


def item_blocks(benchmark: DataFrame, rate: float, id_col: str, text_col: str, least_chars: int) -> Iterator[list[Item]]:
    """The benchmark in blocks of at most BLOCK_CHARS characters, one after another through the driver."""
    block: list[Item] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t")).toLocalIterator():
        text = normalized(r["t"])
        if len(text) < max(1, least_chars):
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(Item.of(r["i"], text, rate))
        size += len(text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = ERROR_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_chars: int = 1,
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document row and each benchmark item found in it.

    Texts are compared in lower case with white space collapsed; ``start`` and ``end`` are characters of that form,
    of the best occurrence, the first among equals. An item may differ by ``rate`` of its characters, inserted,
    deleted or replaced; one under ``EDITABLE_CHARS`` characters must occur as it is, with no letter or digit beside it.
    Null and empty texts match nothing, as do items under ``least_chars`` characters (by default none); repeated
    rows and items each give their own rows; null ids stay null; an empty table on either side gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, rate, item_col, item_text_col, least_chars):

        def run(batches: Iterator[pa.RecordBatch], block: list[Item] = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in batches:
                ids = batch.column("doc_id")
                out: list[tuple] = []
                for k in range(batch.num_rows):
                    hits = matcher.find(normalized(batch.column("text")[k].as_py()))
                    out += [(ids[k].as_py(), block[i].item_id, *hit) for i, hit in hits.items()]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "distance", "start", "end"), row)) for row in out],
                    schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]),
                )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def holds_none(block: list[Item], text: Column) -> Column:
    """Whether a text holds none of the items; only texts go to Python and only the answers come back."""

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(block)
        for column in texts:
            yield pa.array([not matcher.find(normalized(t.as_py())) for t in column], pa.bool_())

    return clean(text)


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = ERROR_RATE,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_chars: int = 1,
) -> DataFrame:
    """The rows of ``docs`` in which ``find_leaks`` would find no item, with all their columns."""
    small_batches(docs.sparkSession)
    out = docs
    for block in item_blocks(benchmark, rate, item_col, item_text_col, least_chars):
        out = out.where(holds_none(block, text_of(text_col)))
    return out
