"""Hidden Markov language model over words, with Baum-Welch counts summed over all training documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, hashes_of_words, id_bucket, mix64, sub_batches, text_batches, text_of, word_spans

STATES = 8
#: The most frequent words, each a symbol of its own; other words are symbols by their last three bytes.
SYMBOL_WORDS = 32_768
ENDINGS = 2_048
#: Words whose counts every task holds, at most; counts of all others are joined.
HELD_WORDS = 262_144
#: Baum-Welch ends with the round whose model is better than the last by less than this, in nats a token.
LEAST_GAIN = 5e-3
#: The most frequent symbols, whose pairs in all training texts give the first model.
PAIR_SYMBOLS = 512
PAIR_ROUNDS = 200
#: Weight, in tokens, of the overall symbol shares within each state's emissions.
PRIOR_TOKENS = 2_000.0
BATCH = 1 << 20
#: Tokens that the recursion holds at once, whatever the texts' lengths.
BATCH_TOKENS = 1 << 17
#: Longer sequences are run as segments side by side, with their exact vectors at both ends.
SEGMENT = 1024
_U = np.uint64
END_WORD = _U(0xE7D5E7D5E7D5E7D5)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each row, endings of the words (-1 for an end), and each row's first token."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    words = hashes_of_words(low, starts, ends)
    tail = low[ends - 1].astype(np.uint64)
    for k in (2, 3):
        tail = tail * _U(257) + np.where(ends - k >= starts, low[np.maximum(ends - k, 0)].astype(np.uint64) + _U(1), _U(0))
    endings = (mix64(tail) % _U(ENDINGS)).astype(np.int32)
    rows = len(offsets) - 1
    bounds = first + np.arange(rows + 1)
    out = np.full(len(words) + rows, END_WORD)
    kind = np.full(len(out), -1, np.int32)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner], kind[inner] = words, endings
    return out, kind, bounds


class WordTable:
    """Index of each given word hash, or -1: one slot a word, the few that collide in a sorted list."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = max(10, int(len(words)).bit_length() + 4)
        slot = (words >> _U(64 - self.bits)).astype(np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(words), dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.slots[slot] != np.arange(len(words)))
        order = np.argsort(words[rest])
        self.rest, self.rest_words = rest[order], words[rest][order]

    def look_up(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = self.slots[(words >> _U(64 - self.bits)).astype(np.int64)].astype(np.int64)
        at[self.words[at] != words] = -1
        if len(self.rest):
            missed = np.flatnonzero(at < 0)
            place = np.minimum(np.searchsorted(self.rest_words, words[missed]), len(self.rest) - 1)
            hit = self.rest_words[place] == words[missed]
            at[missed[hit]] = self.rest[place[hit]]
        return at


@dataclass
class Vocabulary:
    """Bounded tables: held words with counts, most frequent first; totals; and figures of each ending's other words."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    end_count: int
    ending_count: np.ndarray
    ending_single: np.ndarray

    def __post_init__(self) -> None:
        self.table = WordTable(self.words)
        self.own = min(SYMBOL_WORDS, len(self.words))
        self.size = self.own + ENDINGS + 1
        # an unseen word's share among the rare words of its ending, from those seen once
        self.unseen = (self.ending_single + 1.0) / (self.ending_count + 2.0)

    def __reduce__(self):
        fields = ("words", "counts", "total", "distinct", "end_count", "ending_count", "ending_single")
        return Vocabulary, tuple(getattr(self, f) for f in fields)

    def symbols(self, words: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each token, and its place among the held words or -1."""
        held = self.table.look_up(words)
        own = (held >= 0) & (held < self.own)
        return np.where(endings < 0, self.size - 1, np.where(own, held, self.own + endings)), held

    def shares(self) -> np.ndarray:
        counts = np.concatenate([self.counts[: self.own], self.ending_count, [self.end_count]]) + 0.5
        return counts / counts.sum()


@dataclass
class Segments:
    """Stretches of sequences: first token, tokens, and the vectors that the recursion has before, after and just before the cut."""

    lo: np.ndarray
    length: np.ndarray
    before: np.ndarray
    after: np.ndarray
    previous: np.ndarray

    def take(self, some: np.ndarray) -> Segments:
        return Segments(self.lo[some], self.length[some], self.before[some], self.after[some], self.previous[some])


@dataclass
class Chain:
    """Start, move and emission probabilities; emissions by symbol, one column a state."""

    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray

    def run(self, symbols: np.ndarray, bounds: np.ndarray, counts: Chain | None = None) -> np.ndarray:
        """Natural log-likelihood of each sequence by the scaled forward recursion; adds expected counts to ``counts``.

        Sequences are cut into segments. The product of a segment's step matrices carries the state vector over it, so
        that every segment starts (and, for counts, ends) with the very vector that one long recursion would have there.
        Sums for ``counts`` are in single precision, likelihoods without them in double.
        """
        size = np.diff(bounds)
        pieces = np.maximum(-(-size // SEGMENT), 1)
        doc = np.repeat(np.arange(len(size)), pieces)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = bounds[:-1][doc] + part * SEGMENT
        length = np.minimum(lo + SEGMENT, bounds[1:][doc]) - lo
        kind = np.float64 if counts is None else np.float32
        segments = Segments(lo, length, np.tile(self.start, (len(doc), 1)), np.ones((len(doc), STATES)), np.zeros((len(doc), STATES)))
        emit = self.emit.astype(kind, copy=False)
        self._carry(symbols, segments, part, pieces[doc] > 1, emit)
        logs = np.zeros(len(size))
        order = np.argsort(-length, kind="stable")
        for a, b in sub_batches(np.concatenate([[0], np.cumsum(length[order])]), BATCH_TOKENS):
            some = order[a:b]
            logs += np.bincount(doc[some], weights=self._run_segments(symbols, segments.take(some), part[some] == 0, emit, counts), minlength=len(size))
        return logs

    def _carry(self, symbols: np.ndarray, segments: Segments, part: np.ndarray, long: np.ndarray, emit: np.ndarray) -> None:
        """Fills in the vectors at the cuts of sequences of more than one segment."""
        if not long.any():
            return
        which = np.flatnonzero(long)
        over = np.empty((len(which), STATES, STATES))
        begun, moves = np.diag(self.start).astype(emit.dtype), self.moves.astype(emit.dtype)
        by_length = np.argsort(-segments.length[which], kind="stable")
        for a in range(0, len(which), 512):
            some = which[by_length[a : a + 512]]
            lo, length = segments.lo[some], segments.length[some]
            made = np.where((part[some] == 0)[:, None, None], begun, moves) * emit[symbols[lo]][:, None, :]
            ahead = np.empty_like(made)
            for t in range(1, int(length[0])):
                n = int(np.searchsorted(-length, -t, side="left"))
                here = ahead[:n]
                np.matmul(made[:n].reshape(-1, STATES), moves, out=here.reshape(-1, STATES))
                here *= emit[symbols[lo[:n] + t]][:, None, :]
                if t % 2:
                    here /= here.sum((1, 2), keepdims=True)
                if n < len(made):
                    over[by_length[a + n : a + len(made)]] = made[n:]
                made, ahead = here, made[:n]
            over[by_length[a : a + len(made)]] = made
        for k, s in enumerate(which.tolist()):
            at = over[k].sum(0) if part[s] == 0 else at @ over[k]
            at = at / at.sum()
            if k + 1 < len(which) and part[which[k + 1]]:
                segments.before[s + 1], segments.previous[s + 1] = at @ self.moves, at
        for k in range(len(which) - 1, 0, -1):
            s = which[k]
            if part[s]:
                back = over[k] @ segments.after[s]
                segments.after[s - 1] = back / (segments.previous[s] @ back)

    def _run_segments(self, symbols: np.ndarray, segments: Segments, first: np.ndarray, table: np.ndarray, counts: Chain | None) -> np.ndarray:
        """The recursion over segments, the longest first, laid out time by time: one step serves all that still run."""
        steps = int(segments.length[0]) if len(first) else 0
        active = np.searchsorted(-segments.length, -np.arange(steps), side="left")
        at = np.concatenate([[0], np.cumsum(active)])
        step = np.repeat(np.arange(steps), active)
        rank = np.arange(at[-1]) - at[step]
        laid = symbols[segments.lo[rank] + step]
        emit = table[laid]
        moves = self.moves.astype(emit.dtype)
        alpha = np.empty_like(emit)
        scale = np.empty(len(emit), emit.dtype)
        for t in range(steps):
            a, b = at[t], at[t + 1]
            here = alpha[a:b]
            if t == 0:
                np.multiply(segments.before, emit[a:b], out=here, casting="same_kind")
            else:
                np.matmul(alpha[at[t - 1] : at[t - 1] + b - a], moves, out=here)
                here *= emit[a:b]
            total = here.sum(1)
            scale[a:b] = total
            here /= total[:, None]
        logs = np.bincount(rank, weights=np.log(scale), minlength=len(first))
        if counts is None or not steps:
            return logs
        emit /= scale[:, None]
        back = moves.T.copy()
        beta = np.empty_like(alpha)
        ends = at[segments.length - 1] + np.arange(len(first))
        beta[ends] = segments.after
        # emissions times beta replace the emissions, from the last step to the first
        emit[ends] *= beta[ends]
        for t in range(steps - 2, -1, -1):
            a, b = at[t + 1], at[t + 2]
            here = beta[at[t] : at[t] + b - a]
            np.matmul(emit[a:b], back, out=here)
            emit[at[t] : at[t] + b - a] *= here
        begun = slice(0, at[1])
        counts.start += (alpha[begun] * beta[begun])[first].sum(0)
        moved = segments.previous.T @ emit[begun]
        for t in range(1, steps):
            a, b = at[t], at[t + 1]
            moved += alpha[at[t - 1] : at[t - 1] + b - a].T @ emit[a:b]
        counts.moves += self.moves * moved
        alpha *= beta
        order = np.argsort(laid, kind="stable")
        found = laid[order]
        begin = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        counts.emit[found[begin]] += np.add.reduceat(alpha[order], begin, axis=0)
        return logs

    @classmethod
    def empty(cls, symbols: int) -> Chain:
        return cls(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((symbols, STATES)))

    def normalized(self, shares: np.ndarray) -> Chain:
        """The model of expected counts, with a prior of one start and move each and PRIOR_TOKENS by overall share."""
        start = self.start + 1.0
        moves = self.moves + 1.0
        emit = self.emit + PRIOR_TOKENS * shares[:, None]
        return Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def pair_codes(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbols, of which all past the most frequent count as one."""
    k = PAIR_SYMBOLS
    small = np.minimum(symbols, k - 1).astype(np.int64)
    code = small[:-1] * k + small[1:]
    inner = np.ones(len(code), bool)
    inner[bounds[1:-1] - 1] = False
    return np.bincount(code[inner], minlength=k * k)


def first_chain(shares: np.ndarray, pairs: np.ndarray) -> Chain:
    """The model that Baum-Welch on the counted pairs alone, taken as sequences of two, comes to from a random one.

    Symbols past the most frequent share the emission of the pairs' last symbol by their overall shares.
    """
    k = PAIR_SYMBOLS
    near = pairs.reshape(k, k)
    weight = near.sum(1) + near.sum(0) + 1e-3
    emit = weight[:, None] * np.random.default_rng(5).uniform(0.5, 1.5, (k, STATES))
    emit /= emit.sum(0)
    start, moves = np.full(STATES, 1.0 / STATES), np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    for _ in range(PAIR_ROUNDS):
        left = emit * start
        ratio = near / np.maximum(left @ moves @ emit.T, 1e-300)
        right = ratio @ emit
        first, second = left * (right @ moves.T), emit * ((ratio.T @ left) @ moves)
        moves = moves * (left.T @ right) + 1.0
        moves /= moves.sum(1, keepdims=True)
        emit = first + second + 1e-3 * weight[:, None] / weight.sum()
        start = first.sum(0) + 1.0
        emit, start = emit / emit.sum(0), start / start.sum()
    rest = np.arange(len(shares)) >= k - 1
    full = np.where(rest[:, None], shares[:, None] / max(shares[rest].sum(), 1e-300) * emit[-1], emit[np.minimum(np.arange(len(shares)), k - 1)])
    full = full + 1e-3 * shares[:, None]
    return Chain(start, moves, full / full.sum(0))


def counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct words within a task's stretches of text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        words, kinds = (np.concatenate(x) for x in zip(*held))
        distinct, first, n = np.unique(words, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(kinds[first]), pa.array(n)], names=["word", "ending", "n"])

    for _, data, offsets in text_batches(batches):
        words, kinds, _ = tokens(data, offsets)
        held.append((words, kinds))
        waiting += len(words)
        if waiting > 2_000_000:
            yield flush()
            held, waiting = [], 0
    if held:
        yield flush()


def fit_vocabulary(scratch: Scratch, taught: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Counts of all words of the training texts as a table (word, ending, c), and the bounded figures."""
    counted = taught.select("text").mapInArrow(counted_rows, "word long, ending int, n long")
    table = scratch.table(counted.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("c")))
    totals = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("ending") < 0, F.col("c"))), F.lit(0)).alias("e")).head()
    # how many words have each count tells from which count on the words can be held
    words_of = table.where("ending >= 0").groupBy("c").agg(F.count(F.lit(1)).alias("words")).toArrow()
    c, n = words_of.column("c").to_numpy(), words_of.column("words").to_numpy()
    fits = np.cumsum(n[np.argsort(-c)]) <= HELD_WORDS
    least = int(np.sort(c)[::-1][fits].min()) if fits.any() else 1 << 62
    top = table.where((F.col("ending") >= 0) & (F.col("c") >= least)).select("word", "c").toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    counts = top.column("c").to_numpy().astype(np.int64)
    order = np.lexsort((words, -counts))
    words, counts = words[order], counts[order]
    ending_count, ending_single = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in table.where("ending >= 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") == 1, 1)).alias("one")).collect():
        ending_count[r["ending"]], ending_single[r["ending"]] = r["c"], r["one"]
    vocabulary = Vocabulary(words, counts, int(totals["n"]), int(totals["v"]), int(totals["e"]), ending_count, ending_single)
    if vocabulary.own:
        own = table.join(F.broadcast(scratch.spark.createDataFrame(pa.table({"word": pa.array(words[: vocabulary.own].view(np.int64))}))), "word")
        for r in own.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") == 1, 1)).alias("one")).collect():
            ending_count[r["ending"]] -= r["c"]
            ending_single[r["ending"]] -= r["one"]
    return Vocabulary(words, counts, vocabulary.total, vocabulary.distinct, vocabulary.end_count, ending_count, ending_single), table


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and bounds of a batch's sequences."""
    column = batch.column("symbols")
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), offsets - offsets[0]


def fit_chain(scratch: Scratch, taught: DataFrame, vocabulary: Vocabulary) -> Chain:
    """Baum-Welch with counts over all training texts in every round, until the likelihood stops rising."""
    shares = vocabulary.shares()
    context = scratch.spark.sparkContext
    sent_words = context.broadcast(vocabulary)

    def symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_batches(batches, most=BATCH):
            words, kinds, bounds = tokens(data, offsets)
            symbols = sent_words.value.symbols(words, kinds)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(symbols))], names=["symbols"])

    told = scratch.table(taught.select("text").mapInArrow(symbol_rows, "symbols array<int>"))

    def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIR_SYMBOLS**2, np.int64)
        for batch in batches:
            total += pair_codes(*_sequences(batch))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["pair", "n"])

    met = told.mapInArrow(pair_rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(PAIR_SYMBOLS**2)
    pairs[met.column("pair").to_numpy()] = met.column("n").to_numpy()
    chain = first_chain(shares, pairs)
    columns = [f"c{k}" for k in range(STATES)]
    size, before = vocabulary.size, -np.inf
    while True:
        sent = context.broadcast(chain)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, counts, logs = sent.value, Chain.empty(size), np.zeros((1, STATES))
            for batch in batches:
                logs[0, 0] += model.run(*_sequences(batch), counts).sum()
            rows = np.concatenate([counts.emit, counts.moves, counts.start[None], logs])
            used = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, k]) for k in range(STATES))], names=["row", *columns])

        made = told.mapInArrow(expect, "row long, " + ", ".join(f"{c} double" for c in columns))
        summed = made.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        sent.unpersist()
        rows = np.zeros((size + STATES + 2, STATES))
        if summed.num_rows:
            rows[summed.column("row").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in columns], 1)
        chain = Chain(rows[-2], rows[size:-2], rows[:size]).normalized(shares)
        if rows[-1, 0] - before < LEAST_GAIN * max(1, vocabulary.total):
            scratch.drop(told)
            return chain
        before = rows[-1, 0]


def score_texts(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every whole text under the model and under an add-0.1 unigram base.

    Learned from the rows with crc32(id) mod ``folds`` other than 0. Tokens are words (runs of bytes outside white
    space, A-Z lowered) and one end for each text. Returns doc_id, held_out, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score and score. The model emits symbols, frequent words or three-byte endings; a
    rare word's probability is its symbol's times its share among the ending's rare words, with a Good-Turing share
    for unseen ones. Null and empty texts are an end alone; repeated rows are scored each; without training rows all
    words are unseen; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm-lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("held_out", id_bucket("doc_id", folds) == 0)
    taught = rows.where("NOT held_out")
    vocabulary, table = fit_vocabulary(scratch, taught)
    chain = fit_chain(scratch, taught, vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary, chain))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = sent.value
        floor = np.log10(known.total + 0.1 * (known.distinct + 1))
        seen_share = np.log10((1 - known.unseen) / np.maximum(known.ending_count, 1e-9))
        for part, data, offsets in text_batches(batches, most=BATCH):
            words, kinds, bounds = tokens(data, offsets)
            symbols, held = known.symbols(words, kinds)
            logs = model.run(symbols, bounds) / np.log(10)
            row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            count = np.where(kinds < 0, known.end_count, np.where(held >= 0, known.counts[np.maximum(held, 0)] if len(known.counts) else 0, 0))
            local = (kinds < 0) | (held >= 0)
            base = np.where(local, np.log10(count + 0.1), 0.0)
            rare = (kinds >= 0) & (held >= known.own)
            extra = np.where(rare, np.log10(np.maximum(count, 1)) + seen_share[np.maximum(kinds, 0)], 0.0)
            n = part.num_rows
            add = lambda x: np.bincount(row, weights=x, minlength=n)
            away = ~local
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[away], minlength=n))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[away])) for x in (words.view(np.int64), kinds)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("uid"),
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(np.diff(bounds)),
                    pa.array(add((count > 0) & local).astype(np.int64)),
                    pa.array(add(base) - floor * np.diff(bounds)),
                    pa.array(logs + add(extra)),
                    *lists,
                ],
                names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "words", "endings"],
            )

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, words array<long>, endings array<int>"
    scored = scratch.table(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(score, schema))
    shares = spark.createDataFrame(
        pa.table(
            {
                "ending": pa.array(np.arange(ENDINGS, dtype=np.int32)),
                "seen": pa.array(np.log10((1 - vocabulary.unseen) / np.maximum(vocabulary.ending_count, 1e-9))),
                "unseen": pa.array(np.log10(vocabulary.unseen)),
            }
        )
    )
    pairs = scored.select("uid", F.explode(F.arrays_zip("words", "endings")).alias("t")).select("uid", F.col("t.words").alias("word"), F.col("t.endings").alias("ending"))
    met = pairs.join(table.select("word", "c"), "word", "left").join(F.broadcast(shares), "ending")
    terms = met.groupBy("uid").agg(
        F.count("c").alias("more_known"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more_base"),
        F.sum(F.when(F.col("c").isNull(), F.col("unseen")).otherwise(F.log10("c") + F.col("seen"))).alias("more_model"),
    )
    whole = scored.drop("words", "endings").join(terms, "uid", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
    )
