"""Encoding of texts by their distinct pieces, cut where no token of the tokenizer can cross."""

from __future__ import annotations

import os
import secrets
from functools import lru_cache

import numpy as np

from .common import FIELD, SPACE, RangeCode, word_spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
#: Slots of a worker's table of remembered pieces; a slot holds the piece met last.
SLOTS = 1 << 20
#: Token ids that a worker remembers; when more come, it starts afresh.
MEMORY_IDS = 4 << 20
#: Pieces given to the tokenizer at once.
ENCODE_AT_ONCE = 4096
WORDS_A_LINE = 64
#: Fixed value: how tokenizers with word ends mark a word's last token.
WORD_END = "</w>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


def _mark_cuts(data: np.ndarray) -> np.ndarray:
    """Bytes . , ; : ! ? just after an ASCII letter: patterns that part letters from marks cut here as well."""
    cut = np.zeros(len(data), bool)
    cut[1:] = _MARK[data[1:]] & _LETTER[data[:-1]]
    return cut


def spaced_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces for a byte-level BPE that keeps white space; each row's first piece.

    A piece begins with the last white-space byte of a run, just before a byte that is none, or with a mark after a
    letter. The pattern of such tokenizers joins at most one space to the word after it and leaves the rest of a run
    to itself, so a piece has the same tokens alone and in place, however long the text is.
    """
    space = SPACE[data]
    cut = _mark_cuts(data)
    if len(data):
        cut[:-1] |= space[:-1] & ~space[1:]
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def bare_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The like for a tokenizer that drops white space: words, cut before a mark after a letter."""
    starts, ends, _ = word_spans(data, offsets)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    cuts = np.flatnonzero(_mark_cuts(data) & (np.cumsum(inside[:-1]) > 0))
    first = np.zeros(len(data), bool)
    last = np.zeros(len(data), bool)
    first[starts], last[ends - 1] = True, True
    cuts = cuts[~first[cuts]]
    first[cuts], last[cuts - 1] = True, True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class PieceMemory:
    """Token counts, and ids if wanted, of pieces met before, within bounded memory."""

    def __init__(self, path: str, with_ids: bool):
        self.model, self.with_ids = load_tokenizer(path), with_ids
        # a base of this process alone, so that no text can have been written to collide with another's pieces
        self.base = secrets.randbelow(FIELD - (1 << 20)) + (1 << 20)
        vocabulary = self.model.get_vocab()
        ends = [i for t, i in vocabulary.items() if t.endswith(WORD_END)]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if ends else None
        if ends:
            self.ends[ends] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.size = np.zeros(SLOTS, np.int32)
        self.start = np.zeros(SLOTS if self.with_ids else 0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes and places of the pieces' ids, and all these ids.

        Pieces of letters alone go to the tokenizer in lines of many where it marks each word's last token: such a
        line has as many marks as words only if every word is encoded as it is alone. Other lines are done singly.
        """
        size = np.zeros(len(texts), np.int64)
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        words = [i for i, t in enumerate(texts) if t.isalpha()] if self.ends is not None else []
        single = set(range(len(texts))).difference(words)
        groups = [words[k : k + WORDS_A_LINE] for k in range(0, len(words), WORDS_A_LINE)]
        for k in range(0, len(groups), ENCODE_AT_ONCE // WORDS_A_LINE):
            some = groups[k : k + ENCODE_AT_ONCE // WORDS_A_LINE]
            lines = [" ".join([texts[i] for i in g]) for g in some]
            for g, e in zip(some, self.model.encode_batch_fast(lines, add_special_tokens=False)):
                found = np.array(e.ids, np.uint32)
                last = np.flatnonzero(self.ends[found])
                if len(last) != len(g):
                    single.update(g)
                    continue
                size[g] = np.diff(last, prepend=-1)
                ids.append(found)
                rows.append(np.array(g))
        rest = sorted(single)
        for k in range(0, len(rest), ENCODE_AT_ONCE):
            some = rest[k : k + ENCODE_AT_ONCE]
            found = [e.ids for e in self.model.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
            size[some] = [len(one) for one in found]
            ids.append(np.fromiter((i for one in found for i in one), np.uint32))
            rows.append(np.array(some))
        order = np.concatenate(rows)
        place = np.zeros(len(texts), np.int64)
        place[order] = np.cumsum(size[order]) - size[order]
        return size, place, np.concatenate(ids)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each piece, and where its ids begin in ``ids``."""
        if self.with_ids and len(self.ids) > MEMORY_IDS:
            self.clear()
        keys = RangeCode(data, self.base).hashes(starts, ends) | np.uint64(1)
        slot = (keys >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        size = self.size[slot]
        start = self.start[slot] if self.with_ids else size
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            fresh, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            at = new[first]
            sizes, place, ids = self._encode([raw[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            size[new] = sizes[back]
            self.keys[slot[at]], self.size[slot[at]] = fresh, sizes
            if self.with_ids:
                begin = (place + len(self.ids)).astype(np.int32)
                start[new] = begin[back]
                self.start[slot[at]] = begin
                self.ids = np.concatenate([self.ids, ids])
        return size, start

    def all_ids(self, size: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Ids of all looked-up pieces in order."""
        size = size.astype(np.int64)
        take = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.ids[take]


@lru_cache(maxsize=2)
def piece_memory(path: str, with_ids: bool) -> PieceMemory:
    """One memory for a worker process, whatever tasks it runs."""
    return PieceMemory(path, with_ids)
