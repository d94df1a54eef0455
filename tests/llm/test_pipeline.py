"""run() of the corpus pipeline against plain Python, stage by stage on each stage's own input."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from orrery.llm import pieces
from orrery.llm.pieces import tokenizer_path

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "tu") for b in ("ra", "se", "vi") for c in ("n", "l", "ta", "do")]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n)).capitalize() + "."


PASSAGE, ITEM = prose(900, 70), prose(901, 30)
GOOD = [prose(k, 60) for k in range(40)]
BAD = ["\n".join(" ".join(w.upper() + "!!" for w in random.Random(500 + 9 * k + j).choices(WORDS, k=8)) for j in range(5)) for k in range(40)]
NEAR = [" ".join([*GOOD[k].split()[:-1], "other"]) for k in range(3)]
TEXTS = [*GOOD, *BAD, *NEAR, GOOD[5], *[prose(600 + k, 30) + "\n" + PASSAGE + "\n" + prose(700 + k, 30) for k in range(3)], prose(800, 40) + " " + ITEM + " " + prose(801, 20), None, ""]
ROWS = [(k, t, "en", "s", 0 if t is None else len(t), f"r{k}") for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Rows after each stage, the input first."""
    root = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _none string"
    spark.createDataFrame(ROWS, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "x y")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    now, out = spark.read.parquet(f"{root}/documents.parquet"), []
    out.append({r.doc_id: r for r in now.collect()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(root)).write.parquet(f"{root}/{name}")
        now = spark.read.parquet(f"{root}/{name}")
        out.append({r.doc_id: r for r in now.collect()})
    return out, corpus_pipeline.run(spark, str(root)).collect()


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode())
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def test_quality_keeps_good_and_drops_bad(staged):
    kept = staged[0][1]
    assert set(range(40)) <= set(kept) and not set(range(40, 80)) & set(kept)


def test_one_of_each_class_stays(staged):
    before, after = staged[0][1], staged[0][2]
    ids = sorted(before)
    sets = {k: shingles(before[k].text, corpus_pipeline.NEAR_WIDTH) for k in ids}
    root = {k: k for k in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert set(after) == {top(k) for k in ids}
    assert len(after) < len(before)


def test_repeats_go_and_all_else_stays(staged):
    before, after = staged[0][2], staged[0][3]
    assert before.keys() == after.keys()
    window = corpus_pipeline.REPEAT_BYTES
    bodies = {k: (r.text or "").encode() for k, r in before.items()}
    seen = collections.Counter(b[p : p + window] for b in bodies.values() for p in range(len(b) - window + 1))
    cut = 0
    for k, b in bodies.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        want = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert after[k].text == (None if before[k].text is None else want)
        assert after[k]["_none"] == before[k]["_none"] and after[k].n_chars == (len(want) if gone.any() else before[k].n_chars)
        cut += gone.any()
    assert cut == 3


def test_leaks_go_and_clean_documents_stay(staged):
    before, after = staged[0][3], staged[0][4]
    plain = lambda t: " ".join((t or "").lower().split())
    assert set(before) - set(after) == {k for k, r in before.items() if plain(ITEM) in plain(r.text)}
    assert len(after) == len(before) - 1


def test_packing_holds_the_rest(staged):
    kept, packed = staged[0][4], staged[1]
    model = pieces.load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = {k: np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for k, r in kept.items()}
    assert {r.doc_id: (r.piece, r.length, r.ids_crc32) for r in packed} == {k: (0, len(v), zlib.crc32(v.tobytes())) for k, v in want.items()}
    for s in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= corpus_pipeline.SEQUENCE_TOKENS
