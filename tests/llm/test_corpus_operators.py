"""Each operator on a small table with nulls, empty and long texts, repeated rows, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import ann, decontaminate, exact_dup, hmm_lm, licenses, near_dup, packing, pieces, quality, sharding, token_counts
from orrery.llm.common import Scratch, utf8
from orrery.llm.pieces import tokenizer_path

WORDS = [w.decode() for w in re.findall(rb"\w+", b"alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pick long, rid string, _row int, _text string, score double, word string, node int"


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n)).capitalize() + "."


SHARED = prose(99, 90)
TEXTS = [
    None, "", " \n\t ", "one", "One  TWO three", prose(1, 60), prose(1, 60), prose(2, 60) + "\n" + SHARED, prose(3, 50) + "\n" + SHARED + "\n" + prose(4, 20),
    prose(5, 3000), "Né à Genève, l'été.\n" + prose(6, 40), "!!! ### $$$\n" * 12, "x" * 3000, prose(7, 80), prose(7, 80).replace("alpha", "beta", 1), "a\u0000b <|endoftext|>",
    prose(8, 30) + "\nReleased under the MIT License.\n" + prose(9, 30), prose(8, 30) + "\nReleased under the MIT License.\n" + prose(9, 30),
]
ROWS = [(None if k == 6 else k, t, "en", "s", 0 if t is None else len(t), 7, "r", 1, "t", 0.5, "w", 3) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[13], ROWS[0], (None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def body(t):
    return (t or "").encode()


def lowered_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), body(t)))


def test_token_counts(docs, none):
    path = tokenizer_path(token_counts.DEFAULT_TOKENIZER)
    model = pieces.load_tokenizer(path)
    got = sorted(map(str, map(tuple, token_counts.count_tokens(docs, path, 40).collect())))
    counts = [len(model.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    assert got == sorted(str((r[0], len(body(r[1])), n, n > 40)) for r, n in zip(ROWS, counts))
    assert token_counts.count_tokens(none, path).count() == 0


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * sharding.JUMP_MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(2**31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((r[0], len(body(r[1])) + 16, zlib.crc32(body(r[1])), jump(r[0] or 0, 5), jump(r[0] or 0, 6)) for r in ROWS)
    assert want == collections.Counter((g.doc_id, g["size"], g.text_crc32, g.shard, g.grown_shard) for g in got)
    for s in {g.shard for g in got}:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    assert all(g.grown_shard in (g.shard, 5) for g in got)
    assert sharding.shard_documents(none).count() == 0
    keys = spark.createDataFrame([(k,) for k in (-(2**63), -1, 0, 1, 2**63 - 1)], "k long").select("k", sharding.jump_hash(F.col("k"), 40).alias("s")).collect()
    assert all(r.s == jump(r.k, 40) for r in keys)


def test_packing(docs, none):
    path = tokenizer_path(packing.DEFAULT_TOKENIZER)
    model = pieces.load_tokenizer(path)
    got = packing.pack_documents(docs, path, 64).collect()
    want = collections.Counter()
    for r in ROWS:
        ids = np.array([*model.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r[0], k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64)))
    assert want == collections.Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got)
    for s in {g.sequence_id for g in got}:
        at = 0
        for g in sorted((g for g in got if g.sequence_id == s), key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 64
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("window,shard", [(120, 1 << 20), (260, 2000), (60, 300), (17, 40)])
def test_repeats(docs, none, monkeypatch, window, shard):
    monkeypatch.setattr(exact_dup, "GROUP_BYTES", shard)
    seen = collections.Counter(body(r[1])[p : p + window] for r in ROWS for p in range(len(body(r[1])) - window + 1))
    want = collections.Counter()
    for r in ROWS:
        b, gone = body(r[1]), np.zeros(len(body(r[1])) + 2, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p + 1 : p + 1 + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        want[(r[0], len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = exact_dup.remove_repeats(docs, window).collect()
    assert want == collections.Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got)
    assert exact_dup.remove_repeats(none, window).count() == 0


def near_classes(rows, width):
    sets = []
    for r in rows:
        w = lowered_words(r[1])
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = (len(sets[i]), min(ids) if ids else None)
    return out


def test_near_duplicates(docs, none):
    want = near_classes(ROWS, 4)
    got = near_dup.near_duplicates(docs, 4).collect()
    assert collections.Counter((r[0], *want[i]) for i, r in enumerate(ROWS)) == collections.Counter((g.doc_id, g.n_shingles, g.component_id) for g in got)
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.keep_one_of_each(docs, near_dup.near_duplicates(docs, 4))
    assert kept.columns == docs.columns
    classes = {(n, c) if n else i for i, (n, c) in want.items()}
    assert kept.count() == len(classes)


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LEAF_SETS", 4)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 3)
    rng = random.Random(8)
    rows = []
    for group in range(4):
        base = [f"w{group}_{k}" for k in range(120)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    want = near_classes(rows, 4)
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {rows[i][0]: v for i, v in want.items()}


def test_near_duplicates_at_the_bound_in_branched_nodes(spark, monkeypatch):
    """Pairs that share 8 of 10 words, all in nodes that are branched down to the last level."""
    monkeypatch.setattr(near_dup, "LEAF_SETS", 1)
    rows = []
    for pair in range(4000):
        words = [f"w{pair}_{k}" for k in range(10)]
        rows += [(2 * pair, " ".join(words[:9])), (2 * pair + 1, " ".join(words[:8] + words[9:]))]
    got = {g.doc_id: g.component_id for g in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert [k for k in got if got[k] != k - k % 2] == []


def test_quality_on_held_out_documents(spark, none):
    good = [(k, "\n".join(prose(100 + 10 * k + j, 12) for j in range(5)), 1) for k in range(80)]
    bad = [(200 + k, "\n".join(" ".join(w.upper() + "!!" for w in random.Random(k * 9 + j).choices(WORDS, k=8)) for j in range(5)), 0) for k in range(80)]
    rows = good + bad + [(300, None, 1), (301, "", None), (None, "text", 1)]
    docs = spark.createDataFrame([(a, b, 1.0) for a, b, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(a, c, 0) for a, _, c in rows] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    truth = {a: c for a, b, c in rows if b}
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id in truth]
    assert held and all(g.predicted == truth[g.doc_id] for g in held)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id if g.doc_id is not None else "").encode()) % 5 == 0) for g in got)
    assert quality.classify_documents(none, labels).count() == 0
    assert {g.score for g in quality.classify_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_hmm_scores(docs, none):
    got = hmm_lm.score_texts(docs, 10).collect()
    counts = collections.Counter()
    for r in ROWS:
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10:
            counts.update([*lowered_words(r[1]), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r in ROWS:
        words = [*lowered_words(r[1]), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        want.append((str(r[0]), len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    assert sorted(want) == sorted((str(g.doc_id), g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got)
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)
    assert hmm_lm.score_texts(none).count() == 0


def test_hmm_is_fitted_on_all_texts(spark):
    """Scores of training texts, one kind of which is rare, equal those of plain rounds over all until they gain little."""
    rows = [(k, prose(k, 20 + k % 30) if k % 40 else prose(k, 30)[::-1]) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: g.score for g in hmm_lm.score_texts(docs, 10).collect() if not g.held_out}
    taught = [r for r in rows if r[0] in got]
    vocabulary, _ = hmm_lm.fit_vocabulary(Scratch(spark, "test"), spark.createDataFrame(taught, docs.schema))
    words, kinds, bounds = hmm_lm.tokens(*utf8(pa.array([t for _, t in taught])))
    symbols, _ = vocabulary.symbols(words, kinds)
    pairs = hmm_lm.pair_codes(symbols, bounds).astype(float)
    chain, before, gain = hmm_lm.first_chain(vocabulary.shares(), pairs), -math.inf, math.inf
    while gain >= hmm_lm.LEAST_GAIN * vocabulary.total:
        counts = hmm_lm.Chain.empty(vocabulary.size)
        total = chain.run(symbols, bounds, counts).sum()
        chain, before, gain = counts.normalized(vocabulary.shares()), total, total - before
    assert np.allclose(chain.run(symbols, bounds) / np.log(10), [got[k] for k, _ in taught], atol=1e-2)


def test_leaks(spark, docs, none):
    edited = SHARED[:100] + "X" + SHARED[101:]
    items = spark.createDataFrame([(1, SHARED[:200]), (2, edited[:200].upper()), (3, None), (4, "short"), (5, prose(77, 40))], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert sorted((g.doc_id, g.item_id, g.distance) for g in got) == [(7, 1, 0), (7, 2, 1), (8, 1, 0), (8, 2, 1)]
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 2
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == len(ROWS)


def test_licenses(docs, none):
    got = licenses.scan_licenses(docs).collect()
    assert sorted((g.doc_id, g.license, g.containment, g.first_word) for g in got) == [(16, "MIT", 1.0, 30), (17, "MIT", 1.0, 30)]
    assert licenses.scan_licenses(none).count() == 0


def test_license_windows_match_every_window(spark):
    import duckdb

    rng = random.Random(6)
    rows = []
    for k in range(60):
        words = rng.choices(WORDS, k=rng.randint(0, 40))
        notice = licenses.plain_words(rng.choice(licenses.NOTICES)[1])
        for _ in range(rng.randint(0, 3)):
            notice[rng.randrange(len(notice))] = rng.choice(WORDS)
        at = rng.randint(0, len(words))
        rows.append((k, " ".join(words[:at] + notice + words[at:])))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(licenses.oracle()).df()
    key = ["doc_id", "notice"]
    assert len(want) > 10 and got.sort_values(key).reset_index(drop=True)[key + ["containment", "first_word"]].equals(want.sort_values(key).reset_index(drop=True)[key + ["containment", "first_word"]])


@pytest.mark.parametrize("lists,sample,queries", [(1, 20_000, 4096), (32, 400, 3)])
def test_nearest_neighbours(spark, monkeypatch, lists, sample, queries):
    """One list, and many lists from a sample of half the rows, with several blocks and parts of each."""
    monkeypatch.setattr(ann, "LIST_VECTORS", -(-907 // lists))
    monkeypatch.setattr(ann, "SAMPLE_VECTORS", sample)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", queries)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 16_384 if lists == 1 else 20)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 8))
    x = (centers[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 8))).astype(np.float32)
    x[500:540] = x[0]
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(900)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1020, [float("nan")] * 8, 0), (1021, [None] * 8, 0), (1040, [1.0] * 3, 0), (None, [0.5] * 8, 0), (1060, [0.1] * 8, 0), (1060, [0.1] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for g in ann.nearest_neighbours(df, 10).collect():
        got[g.query_id].append((g.rank, g.vec_id, g.score))
    hit = total = 0
    for q in range(0, 900, 20):
        scores = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(a[2] > b[2] or (a[2] == b[2] and (10**9 if a[1] is None else a[1]) <= (10**9 if b[1] is None else b[1])) for a, b in zip(found, found[1:]))
        hit, total = hit + len({i for _, i, _ in found} & set(map(int, best))), total + 10
    assert hit / total >= 0.9 and not {1000, 1001, 1020, 1021, 1040} & set(got)
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    few = ann.nearest_neighbours(df.where("vec_id < 3"), 10).collect()
    assert sorted((g.rank, g.query_id) for g in few) == [(1, 0), (2, 0)]


def test_pipeline_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(k, int(k != 11), 0) for k in range(18)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(13, 40))], "item_id long, text string")
    extra = [(50 + k, prose(13, 40) if k == 0 else prose(60 + k, 30), "en", "s", 1, 1, "r", 1, "t", 0.1, "w", 1) for k in range(4)]
    docs.unionByName(spark.createDataFrame(extra, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(now.count())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] == sizes[3] - 1
    texts = [r.text for r in now.collect()]
    assert sum(SHARED[:200] in (t or "") for t in texts) == 0 and not any(prose(13, 40) in (t or "") for t in texts)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in now.collect()}


def test_lists_are_replicated_and_pruned():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(200, 48))
    x = centers[rng.integers(0, 200, 8000)] + 0.4 * rng.normal(size=(8000, 48))
    index = ann.fit_index(x[:4000], 8000 * ann.LIST_VECTORS // 200, 20)
    row, owner = index.lists_of(x)
    size = np.bincount(owner)
    assert len(size) == 40 and len(row) > 1.05 * len(x)
    asked = np.arange(4000, 8000, 20)
    at, probed = index.probes(x[asked])
    assert size[probed].sum() / len(asked) < 0.5 * len(x)
    hit = 0
    for i, q in enumerate(asked):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score)[:5]
        hit += np.isin(best, row[np.isin(owner, probed[at == i])]).sum()
    assert hit >= 0.9 * 5 * len(asked)
