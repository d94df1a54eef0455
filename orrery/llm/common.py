"""Helpers shared by the corpus operators: scratch tables, byte-bounded batches, word hashing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CHECKPOINT_DIR = "file:/tmp/checkpoints"
BATCH_BYTES = 1 << 19
#: Rows and bytes of one Arrow batch between the JVM and Python, where the session has Spark's own defaults.
ARROW_ROWS, ARROW_BYTES = 2_000, 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local session without one uses /tmp."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or DEFAULT_CHECKPOINT_DIR).rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that no task holds thousands of long texts at once; set limits stay."""
    for key, default, value in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


class Scratch:
    """Tables written to the shared folder, so that lost executors never force a recomputation.

    ``table`` writes a frame as Parquet and reads it back; ``drop`` removes tables which later steps do not read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.made: list[str] = []
        small_batches(spark)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count:03d}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.made.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._delete([t.scratch_path for t in tables])

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Removes all tables that were written for the given ones, which alone are read from now on."""
        kept = {t.scratch_path for t in tables}
        self._delete([p for p in self.made if p not in kept])

    def _delete(self, paths: list[str]) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for p in paths:
            path = hadoop(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.made = [p for p in self.made if p not in set(paths)]


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def sub_batches(offsets: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row where that row alone is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES):
    """(record batch slice, bytes, offsets) with bounded bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for lo, hi in sub_batches(offsets, most):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        del batch, data
        pa.default_memory_pool().release_unused()


# --- words: runs of bytes outside space, tab, newline, vertical tab, form feed, return

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BATCH_BYTES + 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def prefix_code(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of a polynomial code modulo 2**64, for cheap hashes of byte ranges.

    Made strings can collide under it, so it chooses places and ways for strings, and never decides that two are equal.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the bytes stand."""
    inverse = powers(pow(_BASE, -1, 1 << 64), len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts])


# --- hashes that tell byte ranges apart: polynomials over the field of 2**61 - 1 elements

FIELD = (1 << 61) - 1
_P, _LOW = _U(FIELD), _U(0xFFFFFFFF)
#: A base for hashes that must be the same in every session.
FIXED_BASE = 0x1B873593CC9E2D51 % FIELD
_FIELD_BLOCK, _STRETCH = 1 << 19, 1 << 14
_field_powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def hash_bases(spark: SparkSession) -> tuple[int, int]:
    """Two bases drawn from the application's id: no text can have been written to collide under them.

    Two different strings of n bytes then have equal hashes under both with probability (n / 2**61)**2 at most.
    """
    drawn = hashlib.sha512(spark.sparkContext.applicationId.encode()).digest()
    one, two = (int.from_bytes(drawn[k : k + 32], "big") % (FIELD - (1 << 20)) + (1 << 20) for k in (0, 32))
    return one, two


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def field_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of reduced numbers, from products of halves."""
    a1, a0, b1, b0 = a >> _U(32), a & _LOW, b >> _U(32), b & _LOW
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(((a1 * b1) << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) + (low & _P) + (low >> _U(61)))


def _power_list(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, field_product(out, np.full(len(out), pow(base, len(out), FIELD), np.uint64))])
    return out[:n]


class RangeCode:
    """Hashes of any byte ranges of ``data``, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, base: int = FIXED_BASE):
        if base not in _field_powers:
            power = _power_list(base, _FIELD_BLOCK)
            _field_powers.clear() if len(_field_powers) > 4 else None
            _field_powers[base] = power & _LOW, power >> _U(32), _power_list(pow(base, -1, FIELD), _FIELD_BLOCK)
        low, high, self.inverse = _field_powers[base]
        n, blocks = len(data), len(data) // _FIELD_BLOCK + 1
        self.low, self.high = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
        self.low[0] = self.high[0] = 0
        step = pow(base, _FIELD_BLOCK, FIELD)
        self.block_power = np.array([pow(step, k, FIELD) for k in range(blocks)], np.uint64)
        self.block_inverse = np.array([pow(step, -k, FIELD) for k in range(blocks)], np.uint64)
        self.carry = np.zeros(blocks, np.uint64)
        for k in range(blocks):
            lo = k * _FIELD_BLOCK
            hi = min(lo + _FIELD_BLOCK, n)
            # short stretches stay in the cache
            for a in range(lo, hi, _STRETCH):
                b = min(a + _STRETCH, hi)
                code = data[a:b].astype(np.uint64)
                code += _U(1)
                for sums, power in ((self.low, low), (self.high, high)):
                    out = sums[a + 1 : b + 1]
                    np.cumsum(code * power[a - lo : b - lo], out=out)
                    if a > lo:
                        out += sums[a]
            if hi - lo == _FIELD_BLOCK:
                total = self._joined(self.high[hi : hi + 1], self.low[hi : hi + 1])
                self.carry[k + 1] = _reduced(self.carry[k : k + 1] + field_product(self.block_power[k : k + 1], total))[0]
                self.low[hi] = self.high[hi] = 0

    @staticmethod
    def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return _reduced((high >> _U(29)) + ((high & _U((1 << 29) - 1)) << _U(32)) + (low & _P) + (low >> _U(61)))

    def _value(self, at: np.ndarray) -> np.ndarray:
        here = self._joined(self.high[at], self.low[at])
        if len(self.carry) == 1:
            return here
        block = at // _FIELD_BLOCK
        return _reduced(self.carry[block] + field_product(self.block_power[block], here))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.carry) == 1:
            return mix64(field_product(self._joined(self.high[ends] - self.high[starts], self.low[ends] - self.low[starts]), self.inverse[starts]))
        value = field_product(_reduced(self._value(ends) + _P - self._value(starts)), self.inverse[starts % _FIELD_BLOCK])
        if len(self.carry) > 1:
            value = field_product(value, self.block_inverse[starts // _FIELD_BLOCK])
        return mix64(value)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (n+1 entries)."""
    space = SPACE[data]
    first = np.empty(len(data), bool)
    last = np.empty(len(data), bool)
    if len(data):
        first[0], last[-1] = True, True
        first[1:], last[:-1] = space[:-1], space[1:]
        filled = offsets[1:] > offsets[:-1]
        first[offsets[:-1][filled]] = True
        last[offsets[1:][filled] - 1] = True
        first &= ~space
        last &= ~space
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Longest word that the cheap code tells apart; no known way makes such short strings collide under it.
SHORT_WORD = 256


def hashes_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = FIXED_BASE) -> np.ndarray:
    """A 64-bit hash of each word, the same in every session; of long words by the field's polynomial."""
    out = range_hash(prefix_code(data), starts, ends)
    long = np.flatnonzero(ends - starts > SHORT_WORD)
    if len(long):
        out[long] = RangeCode(data, base).hashes(starts[long], ends[long])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, base: int = FIXED_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words in order, and each row's first index (n+1 entries)."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    return hashes_of_words(low, starts, ends, base), rows
