"""Plain helpers against brute force, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import anchors, common, decontaminate, hmm_lm, near_dup, packing, pieces, quality, suffix

SAMPLES = ["", " ", "a", "Two  words", "né à\tl'été. Fin!", "x" * 5000, "<|endoftext|> in text, a,b;c", "a \n\n b", "tab\tand\vmore", "１２３ 日本語 テスト", "don't we'll", "İstanbul ÉCOLE"]


def arrays(texts):
    return common.utf8(pa.array(texts))


def test_utf8_slices_and_nulls():
    column = pa.array(["ab", None, "c", "dé"]).slice(1)
    data, offsets = common.utf8(column)
    assert data.tobytes() == "cdé".encode() and offsets.tolist() == [0, 0, 1, 4]


def test_word_hashes_follow_words():
    data, offsets = arrays(["The the\tTHE", "", "the"])
    words, first = common.word_hashes(data, offsets)
    assert first.tolist() == [0, 3, 3, 4] and len(set(words.tolist())) == 1


@pytest.mark.parametrize("name,cut", [("byte_bpe_50k.json", pieces.spaced_pieces), ("word_bpe_49k.json", pieces.bare_pieces)])
def test_pieces_encode_as_whole_texts(name, cut):
    path = pieces.tokenizer_path(name)
    model, memory = pieces.load_tokenizer(path), pieces.PieceMemory(path, True)
    texts = SAMPLES + [" ".join(random.Random(k).choices(SAMPLES[2:], k=9)) for k in range(40)]
    data, offsets = arrays(texts)
    for _ in range(2):  # the second time from memory
        starts, ends, first = cut(data, offsets)
        size, begin = memory.look_up(data, starts, ends)
        ids = memory.all_ids(size, begin)
        bounds = np.concatenate([[0], np.cumsum(size)])[first]
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"abc", bytes(range(256))])
        strings = [bytes(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        strings += strings[:1]
        data, end = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
        ends, raw = np.repeat(end, [len(s) for s in strings]), b"".join(strings)
        order = suffix.suffix_array(data, ends)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: ([b + 1 for b in raw[i : ends[i]]] + [0], i))
        shared = suffix.common_prefixes(data, ends, order, 20)
        for a, b in zip(order[1:], order[:-1]):
            x, y = raw[a : ends[a]], raw[b : ends[b]]
            assert shared[a] == next((n for n in range(min(len(x), len(y), 20)) if x[n] != y[n]), min(len(x), len(y), 20))


def test_runs_cover_each_window_once_and_alike():
    text = "".join(random.Random(1).choices("abcde", k=900))
    data, offsets = arrays([text, "short", text[100:700]])
    found = anchors.window_runs(data, offsets, 100)
    seen = sorted(p for lo, n in zip(found["lo"], found["n"]) for p in range(lo, lo + n))
    assert seen == [p for a, b in zip(offsets[:-1], offsets[1:]) for p in range(a, b - 99)]
    owner = {}
    for lo, n, anchor in zip(found["lo"], found["n"], found["anchor"]):
        for p in range(lo, lo + n):
            assert owner.setdefault(data[p : p + 100].tobytes(), anchor) == anchor


def test_packing_plan_equals_item_by_item():
    def single(lengths, capacity):
        left = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, c in enumerate(left) if c >= n]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= n
            else:
                left.append(capacity - n)
        return sorted(left)

    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        bins, counts = {}, {}
        for n, rank, ranks, first, offset in packing.best_fit_plan({n: lengths.count(n) for n in lengths}, capacity):
            assert counts.get(n, 0) == rank
            counts[n] = rank + ranks
            for k in range(ranks):
                bins.setdefault(first + k, []).append((offset, n))
        for placed in bins.values():
            at = 0
            for offset, n in sorted(placed):
                assert offset == at
                at += n
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == single(lengths, capacity)


def edit_distance_to_part(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_pieces_find_every_occurrence_within_budget():
    rng = random.Random(2)
    for _ in range(150):
        pattern = "".join(rng.choices("abcdefgh", k=rng.randint(32, 110)))
        item, edited = decontaminate.Item.of(1, pattern, 0.1), list(pattern)
        for _ in range(rng.randint(0, item.budget + 2)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choices("abcdefgh", k=rng.randint(0, 1))
        noise = ["".join(rng.choices("abcdefgh", k=40)) for _ in range(2)]
        text = noise[0] + "".join(edited) + noise[1]
        least, found = edit_distance_to_part(pattern, text), decontaminate.Matcher([item]).find(text)
        assert bool(found) == (least <= item.budget)
        if found:
            distance, start, end = found[0]
            assert distance == least == edit_distance_to_part(pattern, text[start:end])


def test_forward_backward():
    rng = np.random.default_rng(0)
    chain = hmm_lm.Chain(np.full(hmm_lm.STATES, 1 / hmm_lm.STATES), rng.dirichlet(np.ones(hmm_lm.STATES), hmm_lm.STATES), rng.dirichlet(np.ones(20), hmm_lm.STATES).T)
    sequences = [rng.integers(0, 20, n) for n in (1, 5, 3, 9, 9, hmm_lm.SEGMENT, hmm_lm.SEGMENT + 1, 3 * hmm_lm.SEGMENT + 7)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    counts = hmm_lm.Chain.empty(20)
    logs = chain.run(np.concatenate(sequences), bounds, counts)
    for s, log in zip(sequences, logs):
        a, plain = chain.start * chain.emit[s[0]], 0.0
        for t in s[1:]:
            plain += np.log(a.sum())
            a = (a / a.sum() @ chain.moves) * chain.emit[t]
        assert np.isclose(plain + np.log(a.sum()), log)
    assert np.allclose(chain.run(np.concatenate(sequences), bounds), logs)
    assert np.isclose(counts.emit.sum(), bounds[-1]) and np.isclose(counts.moves.sum(), bounds[-1] - 8) and np.isclose(counts.start.sum(), 8)
    better = chain
    for _ in range(5):  # each round raises the likelihood, but for the small prior
        counts = hmm_lm.Chain.empty(20)
        before = better.run(np.concatenate(sequences), bounds, counts).sum()
        counts.emit *= 1e6
        counts.moves *= 1e6
        counts.start *= 1e6
        better = counts.normalized(np.full(20, 0.05))
        assert better.run(np.concatenate(sequences), bounds).sum() >= before - 1e-3


def test_line_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    x, first = rng.normal(size=(7, quality.FEATURES)), np.array([0, 3, 4, 7])
    model = quality.LineModel(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), rng.normal(size=quality.FEATURES) * 0.2, rng.normal(size=(2, 2)))
    p, u = model.marginals(x, first), x @ model.weights
    for a, b in zip(first[:-1], first[1:]):
        total, good = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            s = [(code >> k) & 1 for k in range(b - a)]
            weight = np.exp(sum(u[a + k] for k in range(b - a) if s[k]) + sum(model.moves[s[k - 1], s[k]] for k in range(1, b - a)))
            total, good = total + weight, good + weight * np.array(s)
        assert np.allclose(good / total, p[a:b])


def test_shingles_of_short_and_empty_texts():
    data, offsets = arrays(["", " \n", "one two", "ONE TWO", "a b c d e", "a b c d e a b c d e"])
    code, bounds = near_dup.shingle_sets(data, offsets, 4)
    assert np.diff(bounds).tolist() == [0, 0, 1, 1, 2, 5]
    digests = near_dup.set_digests(code, bounds)
    assert digests[2] == digests[3] and len(set(digests)) == 4
