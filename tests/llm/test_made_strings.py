"""Strings made to collide under polynomial hashes modulo 2**64 must not be taken for one."""

import hashlib
import random
import zlib

import numpy as np

from orrery.llm import common, exact_dup, hmm_lm, near_dup, packing, pieces, token_counts


def alternating(n, one, other):
    """A Thue-Morse word over two pieces, and its complement."""
    turn = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((one, other)[t] for t in turn), "".join((other, one)[t] for t in turn)


WORDS = alternating(2048, "e", "q")


def test_range_hashes_are_those_of_plain_arithmetic():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, (1 << 19) * 2 + 77, dtype=np.uint8)
    for base in (common.FIXED_BASE, common.FIELD - 2):
        code = common.RangeCode(data, base)
        starts = np.array([0, 5, (1 << 19) - 3, (1 << 19), (1 << 20), len(data) - 9, 17, 100])
        ends = np.array([1, 25, (1 << 19) + 4, (1 << 19) + 1, (1 << 20) + 70, len(data), 17, (1 << 20) + 3])
        for s, e, h in zip(starts.tolist(), ends.tolist(), code.hashes(starts, ends)):
            value = 0
            for b in data[s:e][::-1].tolist():
                value = (value * base + b + 1) % common.FIELD
            assert common.mix64(np.array([value], np.uint64))[0] == h


def test_ranges_across_blocks_hash_alike():
    data = np.random.default_rng(2).integers(0, 256, 3000, dtype=np.uint8)
    long = np.concatenate([np.zeros((1 << 19) - 1000, np.uint8), data, np.zeros(700_000, np.uint8), data])
    at = np.array([(1 << 19) - 1000, len(long) - 3000])
    code = common.RangeCode(long)
    assert len(set(code.hashes(at, at + 3000).tolist())) == 1 and code.hashes(at, at + 3000)[0] == common.RangeCode(data).hashes(np.array([0]), np.array([3000]))[0]


def test_long_words_are_told_apart():
    data = np.frombuffer(" ".join(WORDS).encode(), np.uint8)
    words, _ = common.word_hashes(data, np.array([0, len(data)]))
    assert len(set(words.tolist())) == 2
    assert len(set(hmm_lm.tokens(data, np.array([0, len(data)]))[0].tolist())) == 3


def test_token_counts_and_ids(spark):
    docs = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string").coalesce(1)
    for name, with_ids in ((token_counts.DEFAULT_TOKENIZER, False), (packing.DEFAULT_TOKENIZER, True)):
        model = pieces.load_tokenizer(pieces.tokenizer_path(name))
        ids = [model.encode(t, add_special_tokens=False).ids for t in WORDS]
        assert ids[0] != ids[1]
        if with_ids:
            want = {i: zlib.crc32(np.array([*one, 0][:2048], "<u4").tobytes()) for i, one in enumerate(ids)}
            rows = packing.pack_documents(docs, pieces.tokenizer_path(name), 2048).where("piece = 0").collect()
            assert {r["doc_id"]: r["ids_crc32"] for r in rows} == want
        else:
            rows = token_counts.count_tokens(docs, pieces.tokenizer_path(name)).collect()
            assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(one) for i, one in enumerate(ids)}


def test_near_duplicates(spark):
    docs = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 4, 80).collect()} == {0: 0, 1: 1}


def test_repeats(spark):
    pick = random.Random(3)
    gram = "".join(pick.choice("abcdefghijklmnopqrstuvwvz") for _ in range(32))
    fill = ["".join(pick.choice("klmnoprstu") for _ in range(30)) for _ in range(64)]
    turns = [bin(k).count("1") % 2 for k in range(64)]
    texts = ["".join(gram + ("x", "y")[t ^ flip] + "-" + f for t, f in zip(turns, fill)) for flip in (0, 1)]
    assert len(texts[0]) == 4096 and not any(texts[0][i : i + 400] in texts[1] for i in range(len(texts[0]) - 399))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = exact_dup.remove_repeats(docs, 400).collect()
    assert [(r["n_removed"], r["n_spans"]) for r in rows] == [(0, 0)] * 2
    assert {r["kept_sha256"] for r in rows} == {hashlib.sha256(t.encode()).hexdigest() for t in texts}
