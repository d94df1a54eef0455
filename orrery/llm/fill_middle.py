"""Fill-in-the-middle transformation by piece tables.

A document is a list of descriptors (buffer, start, stop) over two immutable buffers, its text and the sentinels.
Cutting splits the one descriptor of the text, an arrangement permutes descriptors, the inverse arrangement restores
them, and hashes are taken descriptor by descriptor, so no arranged text has to be put together for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches, text_of

# The sentinels before prefix, suffix and middle.
SENTINELS = b"<P><S><M>"
MARK = 3
#: Percentage of texts that stay as they are, counted from the top, and of the others that are arranged suffix first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Places of the parts, prefix 0, middle 1 and suffix 2, in each form's output.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}

TEXT, MARKS = 0, 1
#: Which sentinel stands before which part.
MARK_OF = (0, 2, 1)

Descriptor = tuple[int, int, int]


def split(whole: Descriptor, at: list[int]) -> list[Descriptor]:
    """One descriptor cut at the given places of its buffer, empty parts kept."""
    buffer, lo, hi = whole
    edges = [lo, *at, hi]
    return [(buffer, a, b) for a, b in zip(edges[:-1], edges[1:])]


def arrange(parts: list[Descriptor], form: str) -> list[Descriptor]:
    """The parts prefix, middle, suffix in the form's order, each behind its sentinel."""
    out: list[Descriptor] = []
    for part in ARRANGEMENTS[form]:
        mark = MARK_OF[part] * MARK
        out += [(MARKS, mark, mark + MARK), parts[part]]
    return out


def restore(table: list[Descriptor], form: str) -> list[Descriptor]:
    """The inverse arrangement: descriptors of prefix, middle and suffix, without the sentinels."""
    shown = table[1::2]
    out = [shown[0]] * 3
    for place, part in enumerate(ARRANGEMENTS[form]):
        out[part] = shown[place]
    return out


def stream(table: list[Descriptor], buffers: tuple[memoryview, memoryview]) -> Iterator[memoryview]:
    for buffer, lo, hi in table:
        yield buffers[buffer][lo:hi]


def digest(table: list[Descriptor], buffers: tuple[memoryview, memoryview]) -> str:
    made = hashlib.sha256()
    for piece in stream(table, buffers):
        made.update(piece)
    return made.hexdigest()


def read_table(output: bytes, form: str) -> list[Descriptor]:
    """The piece table of an arranged text, found from its sentinels alone; descriptors lie in the output itself."""
    edges, at = [], 0
    for part in ARRANGEMENTS[form]:
        mark = MARK_OF[part] * MARK
        at = output.index(SENTINELS[mark : mark + MARK], at)
        edges.append(at)
        at += MARK
    ends = [*edges[1:], len(output)]
    return [d for lo, hi in zip(edges, ends) for d in ((TEXT, lo, lo + MARK), (TEXT, lo + MARK, hi))]


def restored_text(output: bytes, form: str) -> bytes:
    """The exact text before the transformation."""
    if form == "plain":
        return output
    view = memoryview(output)
    return b"".join(stream(restore(read_table(output, form), form), (view, view)))


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits from the hash of an id; a null id counts as the empty text."""
    code = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(code[k : k + 4], "big") for k in (0, 4, 8, 12))


def _row(doc_id: int | None, view: memoryview, raw: bytes, lo: int, hi: int, place: np.ndarray, with_text: bool):
    """Result of one text, the bytes ``lo`` to ``hi`` of ``raw``; ``place`` has the place of each code point."""
    n = len(place)
    h1, h2, h3, h4 = draws(doc_id)
    marked = any(raw.find(SENTINELS[k : k + MARK], lo, hi) >= 0 for k in range(0, len(SENTINELS), MARK))
    buffers = (view, memoryview(SENTINELS))
    if not n or marked or h3 % 100 >= PLAIN_FROM:
        table = [(TEXT, lo, hi)]
        code = digest(table, buffers)
        return n, "plain", None, None, code, code, raw[lo:hi] if with_text else None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(place[c]) if c < n else hi for c in (first, second)]
    form = "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"
    table = arrange(split((TEXT, lo, hi), at), form)
    output = b"".join(stream(table, buffers))
    shown = memoryview(output)
    again = digest(restore(read_table(output, form), form), (shown, shown))
    return n, form, first, second - first, digest(table, buffers), again, output if with_text else None


def fill_in_middle(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document cut at two places and rearranged, so that its middle comes last.

    The places, and whether a text stays as it is (``plain``) or has its suffix before its prefix (``spm``) or behind
    it (``psm``), are drawn from the id alone. Returns doc_id, n (code points), form, prefix_chars and middle_chars
    (null if plain), output_sha256, restored_sha256 (of the text rebuilt from output and form) and, with
    ``with_text``, ``output``. Texts that hold a sentinel stay plain, so every output can be undone. Null and empty
    texts are plain and have no code points; repeated rows get equal results; a null id draws as the empty text;
    extra columns are ignored, whatever their names; an empty table gives no rows. A text is read whole, however
    long; a batch holds little more than its longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_batches(batches):
            raw = data.tobytes()
            view = memoryview(raw)
            place = np.flatnonzero((data & 0xC0) != 0x80)
            first = np.searchsorted(place, offsets)
            ids = rows.column("doc_id").to_pylist()
            made = [
                _row(ids[k], view, raw, int(offsets[k]), int(offsets[k + 1]), place[first[k] : first[k + 1]], with_text)
                for k in range(rows.num_rows)
            ]
            columns = [pa.array(c, t) for c, t in zip(zip(*made), types)] if made else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(columns if with_text else columns[:-1])], names=names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    schema += ", output binary" if with_text else ""
    names = [field.split()[0] for field in schema.split(", ")]
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    made = rows.mapInArrow(run, schema)
    return made.withColumn("output", F.col("output").cast("string")) if with_text else made


def undo(arranged: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows of ``fill_in_middle`` with their output, from ``output`` and ``form`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_batches(batches, "output"):
            raw = data.tobytes()
            forms = rows.column("form").to_pylist()
            texts = [restored_text(raw[offsets[k] : offsets[k + 1]], forms[k]).decode("utf-8") for k in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arranged.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, text string")


def oracle() -> str:
    """DuckDB text of the query over ``documents``."""
    draw = lambda k: f"CAST(('0x' || substr(h, {8 * k - 7}, 8)) AS BIGINT)"
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(3)} % 100 >= {PLAIN_FROM} THEN 'plain' WHEN {draw(4)} % 100 < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form,
  least({draw(1)} % (n + 1), {draw(2)} % (n + 1)) AS i, greatest({draw(1)} % (n + 1), {draw(2)} % (n + 1)) AS j FROM a),
c AS (SELECT *, substr(t, 1, i) AS p, substr(t, i + 1, j - i) AS m, substr(t, j + 1) AS s FROM b),
d AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM c),
e AS (SELECT *, CASE form WHEN 'psm' THEN strpos(o, '<S>') ELSE strpos(o, '<P>') END AS two, strpos(o, '<M>') AS three FROM d),
f AS (SELECT *, substr(o, 4, two - 4) AS x, substr(o, two + 3, three - two - 3) AS y, substr(o, three + 3) AS z FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN x || z || y ELSE y || z || x END) AS restored_sha256 FROM f"""
