"""Phrase collocations of each language by best-first growth of frequent phrases under admissible score bounds.

A phrase of ``a`` places, cut into a first part of ``l`` and a rest of ``r`` places, scores a / (l + r) in units of
1 / SCALE; its weakest cut counts. Words and word pairs are counted in full, with pairs of rare words left out. Longer
phrases grow from them: whatever begins with a pair has at most the pair's places, so its score is bounded by the
pair's and its first word's counts, and likewise from the end. A frontier score for each language selects the pairs
that are grown; a pass over the texts counts only phrases which may reach that score, or whose count decides whether
a phrase of that score lies inside a longer one. Where fewer than the wanted number of phrases survive at or above the
frontier, it is lowered for that language and its texts are passed again; at 0 nothing is left out.

What is grown reaches the tasks as bitmaps of fixed size. Their false hits cost counting, never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, mix64, prefix_code, range_hash, sub_batches, text_of, utf8

#: Units of a score, places of a phrase at least, percentage of places at which a longer phrase replaces one inside it.
SCALE, LEAST, INSIDE = 2_000_000, 30, 80
LONGEST = 4
NO_LANGUAGE = "und"
#: Bytes of text looked at together, and rows of one batch of counts.
CHUNK, ROWS = 2 << 20, 1 << 16
#: Bits of a bitmap; beyond some millions of phrases it lets more of the others through.
BITS = 1 << 25
#: Pairs above the frontier, as multiples of the wanted phrases, round by round; after that all are.
FRONTIERS = (2, 16)

# Bytes that end a piece, and bytes between words.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)


class Words:
    """The words of a chunk: number of each among the distinct ones, language and piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, langs: pa.Array):
        low = LOWER[data]
        apart = APART[low]
        first, last = ~apart, ~apart
        first[1:] &= apart[:-1]
        last[:-1] &= apart[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(low))]
        first[edges] = ~apart[edges]
        last[edges - 1] = ~apart[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        owner = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.searchsorted(np.flatnonzero(BREAK[low]), starts) + owner
        size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        buffer = np.ascontiguousarray(low[~apart])
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(buffer)]).dictionary_encode()
        self.word, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        kinds = langs.dictionary_encode()
        self.lang, self.langs = kinds.indices.to_numpy().astype(np.int64)[row[owner]], kinds.dictionary
        self.kinds = max(len(self.names), 1)
        self._pairs: np.ndarray | None = None

    def codes(self) -> np.ndarray:
        """A hash of each place's language and word."""
        lang_data, lang_ends = utf8(self.langs)
        lang = range_hash(prefix_code(lang_data), lang_ends[:-1], lang_ends[1:])
        data, ends = utf8(self.names)
        word = range_hash(prefix_code(data), ends[:-1], ends[1:])
        return mix64(word[self.word] + lang[self.lang] * _STEP)

    def whole(self, width: int) -> np.ndarray:
        """Whether ``width`` words from each place on lie in one piece."""
        return self.piece[: len(self.piece) - width + 1] == self.piece[width - 1 :]

    def counted(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct phrase among those at the given places, and how many of these it has."""
        code = self.lang * self.kinds + self.word
        if width == 1:
            code = code[at]
        else:
            pair = code[:-1] * self.kinds + self.word[1:]
            if width == 2:
                code = pair[at]
            else:
                distinct, number = np.unique(pair, return_inverse=True)
                code = number[at] * self.kinds + self.word[at + 2] if width == 3 else number[at] * len(distinct) + number[at + 2]
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        return at[first], count

    def phrases(self, at: np.ndarray, width: int) -> pa.Array:
        parts = [self.names.take(pa.array(self.word[at + k])) for k in range(width)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if width > 1 else parts[0]
        return joined.cast(pa.string())


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", lang: str = "lang") -> Iterator[Words]:
    """Words of bounded chunks; a long text is cut behind bytes that end a piece, where no phrase can cross."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        ends = np.flatnonzero(BREAK[data]) + 1
        cuts = np.searchsorted(ends, np.arange(CHUNK, len(data), CHUNK)) if len(ends) else np.zeros(0, np.int64)
        edges = np.concatenate([offsets, ends[np.minimum(cuts, len(ends) - 1)] if len(ends) else cuts])
        edges = np.unique(edges)
        row = np.searchsorted(offsets, edges[:-1], side="right") - 1
        for lo, hi in sub_batches(edges, CHUNK):
            yield Words(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], row[lo:hi], batch.column(lang))
            pa.default_memory_pool().release_unused()


# --- bitmaps of what is grown


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes & _U(BITS - 1), (codes >> _U(32)) & _U(BITS - 1)]).astype(np.int64)


def marked(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    a, b = _bits(codes)
    has = lambda at: (bitmap[at >> 6] >> (at & 63).astype(_U)) & _U(1)
    return (has(a) & has(b)).astype(bool)


def grown(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the phrases of ``width`` words, from those of places."""
    out = codes[: max(len(codes) - width + 1, 0)]
    for k in range(1, width):
        out = mix64(out * _STEP + codes[k : k + len(out)])
    return out


def bit_rows(width: int, names: list[str]):
    """(name, slot, bits) of the phrases for which the named flags hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column("phrase"))
            words = Words(data, offsets, np.arange(batch.num_rows), batch.column("lang"))
            # a phrase of width words per row, and no byte in it that ends a piece
            codes = grown(words.codes(), width)[:: width] if width > 1 else words.codes()
            for k, name in enumerate(names):
                own = codes[batch.column(name).to_numpy(zero_copy_only=False)]
                at = _bits(own).ravel()
                slot, place = np.unique(at >> 6, return_inverse=True)
                bits = np.zeros(len(slot), _U)
                np.bitwise_or.at(bits, place, _U(1) << (at & 63).astype(_U))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), k, np.int32)), pa.array(slot), pa.array(bits.view(np.int64))], names=["flag", "slot", "bits"])

    return run


def bitmaps(table: DataFrame, width: int, flags: dict[str, Column]) -> list[np.ndarray]:
    """One bitmap of BITS bits for each flag; their words are all that reaches the driver."""
    rows = table.select("lang", "phrase", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
    made = rows.mapInArrow(bit_rows(width, list(flags)), "flag int, slot long, bits long").groupBy("flag", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    flag, slot, bits = (made.column(c).to_numpy() for c in ("flag", "slot", "bits"))
    out = []
    for k in range(len(flags)):
        bitmap = np.zeros(BITS >> 6, np.int64)
        bitmap[slot[flag == k]] = bits[flag == k]
        out.append(bitmap.view(_U))
    return out


# --- passes over the texts


def counted_rows(width: int, wanted: Callable[[Words], np.ndarray] | None, with_total: bool = False):
    """(lang, phrase, places) of each chunk's wanted phrases; with ``with_total`` also all words of a language, under a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in chunks(batches):
            if len(words.word) < width:
                continue
            ok = words.whole(width)
            at = np.flatnonzero(ok if wanted is None else ok & wanted(words))
            places, counts = words.counted(at, width)
            for k in range(0, len(places), ROWS):
                first, count = places[k : k + ROWS], counts[k : k + ROWS]
                langs = words.langs.take(pa.array(words.lang[first]))
                yield pa.RecordBatch.from_arrays([langs, words.phrases(first, width), pa.array(count)], names=["lang", "phrase", "places"])
            if with_total:
                total = np.bincount(words.lang, minlength=len(words.langs))
                yield pa.RecordBatch.from_arrays([words.langs, pa.nulls(len(total), pa.string()), pa.array(total)], names=["lang", "phrase", "places"])

    return run


def _count(docs: DataFrame, width: int, wanted=None, with_total: bool = False) -> DataFrame:
    rows = docs.mapInArrow(counted_rows(width, wanted, with_total), "lang string, phrase string, places long")
    return rows.groupBy("lang", "phrase").agg(F.sum("places").alias("a"))


def _pairs_of(words: np.ndarray) -> Callable[[Words], np.ndarray]:
    def wanted(w: Words) -> np.ndarray:
        frequent = marked(words, w.codes())
        return frequent[:-1] & frequent[1:]

    return wanted


def _triples_of(frequent: np.ndarray, left: np.ndarray, right: np.ndarray) -> Callable[[Words], np.ndarray]:
    def wanted(w: Words) -> np.ndarray:
        pair = grown(w.codes(), 2)
        known = marked(frequent, pair)
        return known[:-1] & known[1:] & (marked(left, pair)[:-1] | marked(right, pair)[1:])

    return wanted


def _fours_of(frequent: np.ndarray, left: np.ndarray, right: np.ndarray, high: np.ndarray) -> Callable[[Words], np.ndarray]:
    def wanted(w: Words) -> np.ndarray:
        codes = w.codes()
        known = marked(frequent, grown(codes, 2))
        three = grown(codes, 3)
        up = marked(high, three)
        grows = marked(left, three)[:-1] & marked(right, three)[1:]
        return known[:-2] & known[1:-1] & known[2:] & (grows | up[:-1] | up[1:])

    return wanted


# --- scores and bounds, in whole numbers


def share(a: str, rest: str) -> Column:
    """SCALE * a / rest, rounded down; products are decimals, since they may pass 64 bits."""
    return F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(20,0)) DIV CAST({rest} AS DECIMAL(20,0))")


def _with_score(table: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds l, r and score of the cut that scores lowest, the earliest of equals."""
    each = [F.struct(share("a", f"{l} + {r}").alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts, 1)]
    return table.withColumn("_cut", F.array_min(F.array(*each))).withColumns({c: F.col("_cut")[c] for c in ("l", "r", "score")}).drop("_cut")


def _names(width: int) -> dict[str, Column]:
    """The phrase without its last and without its first word."""
    return {"head": F.substring_index("phrase", " ", width - 1), "tail": F.substring_index("phrase", " ", 1 - width)}


def _outside(table: DataFrame, longer: DataFrame, width: int) -> DataFrame:
    """Phrases that do not lie inside one of the longer phrases with INSIDE per cent of their places.

    One word more is enough to look at: what lies between a phrase and a still longer one is at least as frequent as
    the latter.
    """
    inner = longer.select("lang", "a", F.explode(F.array(*_names(width + 1).values())).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    inside = F.col("_most").isNotNull() & (100 * F.col("_most") >= INSIDE * F.col("a"))
    return table.join(most, ["lang", "phrase"], "left").where(~inside).drop("_most")


def mine_phrases(docs: DataFrame, most: int = 2000, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``most`` best phrases of two to four words of every language.

    Texts are lower-cased from A to Z, cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at
    spaces and tabs; phrases lie within pieces. Phrases with fewer than ``least`` places do not count, nor do those
    that lie inside a longer phrase of at least 80 % of their places. Returns lang, rank, phrase, a (places), l and r
    (places of the two parts of the weakest cut), n (all words of the language) and score, by score, places and
    phrase. Null and empty texts have no words; null languages are ``und``; repeated rows count each; other columns
    are ignored, whatever their names; languages without such phrases, and empty tables, give no rows. Texts of any
    length are read whole. Every count is exact.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text_of(text_col).alias("text"))

    counts = scratch.table(_count(texts, 1, with_total=True).where(f"a >= {least} OR phrase IS NULL"))
    words = counts.where("phrase IS NOT NULL")
    (frequent,) = bitmaps(words, 1, {"frequent": F.lit(True)})
    pairs = _count(texts, 2, _pairs_of(frequent)).where(f"a >= {least}").withColumns(_names(2))
    one = words.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f1"))
    two = words.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f2"))
    pairs = scratch.table(_with_score(pairs.join(one, ["lang", "head"]).join(two, ["lang", "tail"]), [("f1", "f2")]).select("lang", "phrase", "a", "f1", "f2", "l", "r", "score"))
    totals = counts.where("phrase IS NULL").select("lang", F.col("a").alias("n"))

    settled: list[DataFrame] = []
    open_ = pairs.select("lang").distinct()
    for factor in (*FRONTIERS, None):
        open_ = scratch.table(open_)
        if open_.isEmpty():
            break
        found, frontier = _above(scratch, texts, pairs, open_, least, None if factor is None else factor * most)
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select("lang")
        done = frontier.where("theta = 0").select("lang").union(enough).distinct()
        settled.append(found.join(F.broadcast(done), "lang", "left_semi") if factor else found)
        open_ = open_.join(done, "lang", "left_anti")

    if not settled:
        return pairs.where("false").select("lang", F.lit(1).cast("long").alias("rank"), "phrase", "a", "l", "r", F.lit(0).cast("long").alias("n"), "score")
    every = reduce(DataFrame.unionByName, settled)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scratch.table(every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).join(totals, "lang"))
    scratch.drop_all_but(best)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _above(scratch: Scratch, texts: DataFrame, pairs: DataFrame, langs: DataFrame, least: int, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """All surviving phrases at or above each language's frontier, the score of its pair of rank ``depth``, and the frontiers."""
    if depth is None:
        frontier = langs.withColumn("theta", F.lit(0).cast("long"))
    else:
        order = Window.partitionBy("lang").orderBy(F.desc("score"))
        at = pairs.join(langs, "lang", "left_semi").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= depth)
        deep = at.groupBy("lang").agg(F.min("score").alias("_s"), F.count(F.lit(1)).alias("_n"))
        frontier = deep.select("lang", F.when(F.col("_n") < depth, 0).otherwise(F.col("_s")).cast("long").alias("theta"))
    frontier = scratch.table(frontier)
    texts = texts.join(frontier.select("lang"), "lang", "left_semi")
    known = pairs.join(frontier, "lang")
    theta = F.col("theta")
    maps = bitmaps(known, 2, {"frequent": F.lit(True), "left": share("a", "f1 + a") >= theta, "right": share("a", "a + f2") >= theta})

    triples = _count(texts, 3, _triples_of(*maps)).where(f"a >= {least}").withColumns(_names(3))
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f12"), "f1")
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    triples = triples.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).join(frontier, "lang")
    triples = scratch.table(_with_score(triples, [("f1", "f23"), ("f12", "f3")]))
    flags = {
        "left": (share("a", "f1 + a") >= theta) & (share("a", "f12 + a") >= theta),
        "right": (share("a", "a + f3") >= theta) & (share("a", "a + f23") >= theta),
        "high": F.col("score") >= theta,
    }
    fours = _count(texts, 4, _fours_of(maps[0], *bitmaps(triples, 3, flags))).where(f"a >= {least}").withColumns(_names(4))
    head = triples.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f123"), "f12", "f1")
    tail = triples.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4"))
    # a phrase without a counted part was counted for a phrase inside it alone; its own score is below the frontier
    fours = fours.join(head, ["lang", "head"], "left").join(tail, ["lang", "tail"], "left").join(frontier, "lang")
    fours = scratch.table(_with_score(fours, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]))

    shown = ["lang", "phrase", "a", "l", "r", "score"]
    parts = [
        _outside(known.where(F.col("score") >= theta), triples, 2).select(shown),
        _outside(triples.where(F.col("score") >= theta), fours, 3).select(shown),
        fours.where("f123 IS NOT NULL AND f234 IS NOT NULL").where(F.col("score") >= theta).select(shown),
    ]
    return scratch.table(reduce(DataFrame.unionByName, parts)), frontier


def oracle(most: int = 2000, least: int = LEAST) -> str:
    """DuckDB text of the query over ``documents``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, {' || chr(32) || '.join(f'w{k}' for k in range(1, m + 1))} AS phrase, count(*) AS f FROM g WHERE w{m} IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}" for m in range(1, LONGEST + 1)
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '{NO_LANGUAGE}') AS lang, string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
p AS (SELECT i, lang, unnest(ps) AS s, unnest(range(len(ps))) AS pi FROM d), q AS (SELECT i, lang, pi, regexp_extract_all(s, '[^\\x20\\x09]+') AS ws FROM p),
w AS (SELECT i, lang, pi, unnest(ws) AS w1, unnest(range(len(ws))) AS pos FROM q),
g AS (SELECT lang, w1, lead(w1, 1) OVER z AS w2, lead(w1, 2) OVER z AS w3, lead(w1, 3) OVER z AS w4 FROM w WINDOW z AS (PARTITION BY i, pi ORDER BY pos)),
tn AS (SELECT lang, count(*) AS n FROM g GROUP BY lang), fc AS ({grams}),
ca AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM fc WHERE m >= 2),
cu AS (SELECT *, unnest(range(1, m)) AS k FROM ca),
sc AS (SELECT cu.lang, cu.phrase, k, a, x.f AS l, y.f AS r, CAST((CAST({SCALE} AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cu JOIN fc x ON x.lang = cu.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN fc y ON y.lang = cu.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc) WHERE o = 1),
su AS (SELECT lang, a, ws, m, unnest(range(1, m)) AS b FROM ca WHERE m >= 3), sv AS (SELECT lang, a, ws, b, unnest(range(b + 1, m + 1)) AS e, m FROM su),
dr AS (SELECT DISTINCT lo.lang, lo.phrase FROM lo JOIN sv ON lo.lang = sv.lang AND lo.phrase = array_to_string(sv.ws[b:e], ' ') WHERE e - b + 1 < m AND 100 * sv.a >= {INSIDE} * lo.a),
ra AS (SELECT lo.*, row_number() OVER (PARTITION BY lo.lang ORDER BY score DESC, a DESC, lo.phrase) AS rank FROM lo ANTI JOIN dr ON lo.lang = dr.lang AND lo.phrase = dr.phrase)
SELECT ra.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM ra JOIN tn ON tn.lang = ra.lang WHERE rank <= {most}"""
