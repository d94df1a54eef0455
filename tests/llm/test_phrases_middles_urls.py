"""Phrase mining, fill-in-the-middle and URL rules against brute force on small, awkward tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import Row

from orrery.llm import collocations, fill_middle, queries, url_filter

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,table", [("op11_collocations", "documents"), ("op12_fill_in_middle", "documents"), ("op13_url_filter", "pages")])
def test_queries_equal_their_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert sorted(order) == columns
    want = sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in found.fetchall())
    assert want and sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


# --- phrases


def plain_phrases(rows, most, least):
    count, total = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    key = (lang, tuple(words[i : i + m]))
                    count[key] = count.get(key, 0) + 1
    out = []
    for (lang, words), a in count.items():
        if len(words) < 2 or a < least:
            continue
        longer = [(w, b) for (g, w), b in count.items() if g == lang and len(w) > len(words) and b >= least]
        if any(100 * b >= 80 * a and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1)) for w, b in longer):
            continue
        cuts = [(2000000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
    out.sort()
    ranks, shown = {}, set()
    for lang, score, a, phrase, l, r in out:
        ranks[lang] = ranks.get(lang, 0) + 1
        if ranks[lang] <= most:
            shown.add((lang, ranks[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return shown


def phrase_rows(seed):
    pick = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "a\xa0b", "é", "x" * 300, "in", "to", "be"]
    rows = []
    for _ in range(120):
        text = []
        for _ in range(pick.randrange(0, 40)):
            text.append(pick.choice(["new York city hall", "to be or not", *words]) if pick.random() < 0.5 else pick.choice(words))
            text.append(pick.choice([" ", "  ", "\t", ". ", ",", "\n", " ? ", "; "] + [" "] * 12))
        rows.append(("".join(text), pick.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), ("   ", "de"), (".,;", "xx"), rows[0], rows[0]]


@pytest.mark.parametrize("most,least,frontiers", [(2000, 3, (2, 16)), (3, 3, (2, 16)), (6, 2, (1, 2)), (1, 4, (1,))])
def test_phrases_by_brute_force(spark, monkeypatch, most, least, frontiers):
    monkeypatch.setattr(collocations, "FRONTIERS", frontiers)
    rows = phrase_rows(most)
    docs = spark.createDataFrame([(t, g, 1, "s", 0) for t, g in rows], "text string, lang string, a int, score string, _r int").repartition(3)
    got = {tuple(r) for r in collocations.mine_phrases(docs, most, least).collect()}
    assert got == plain_phrases(rows, most, least)


def test_phrases_of_long_texts_cut_behind_pieces(spark, monkeypatch):
    rows = [(". ".join(["the cat sat", "the cat ran on the mat"] * 40) + " end without a piece" * 30, "en"), ("one two " * 500, "en")]
    want = plain_phrases(rows, 50, 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": ["en", "en"]})
    whole = [c for w in collocations.chunks(iter([batch])) for c in _counts(w)]
    monkeypatch.setattr(collocations, "CHUNK", 100)
    parts = list(collocations.chunks(iter([batch])))
    assert len(parts) > 10
    assert _summed(whole) == _summed(c for w in parts for c in _counts(w))
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert {tuple(r) for r in collocations.mine_phrases(docs, 50, 5).collect()} == want


def _counts(words):
    import numpy as np

    for m in range(1, 5):
        if len(words.word) >= m:
            at, n = words.counted(np.flatnonzero(words.whole(m)), m)
            yield from zip(words.phrases(at, m).to_pylist(), n.tolist())


def _summed(pairs):
    out = {}
    for phrase, n in pairs:
        out[phrase] = out.get(phrase, 0) + n
    return out


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string, phrase string")
    assert collocations.mine_phrases(empty).collect() == []
    few = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.mine_phrases(few).collect() == []


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**15, 9 * 10**15, 9 * 10**15 + 1)], "a long, l long, r long").select(collocations.share("a", "l + r").alias("s")).head()
    assert row["s"] == 2000000 * 9 * 10**15 // (18 * 10**15 + 1)


# --- middles

LONG = "".join(random.Random(5).choice("ab é漢🙂\n") for _ in range(300_000))
TEXTS = [None, "", "a", "é", "<P>x", "x<S>", "a<M>b", "<", "<P", "P>", "ab<", "🙂🙂", "line\nline\r\n\t", "nul\x00nul", LONG] + [f"text {i} é {'🙂' * (i % 5)} <{'PSM'[i % 3]}" for i in range(300)]


def test_middles_by_plain_python(spark):
    rows = [(i, t, "n", 3) for i, t in enumerate(TEXTS)] + [(None, "no id at all", "n", 3), (20, TEXTS[20], "n", 3), (-7, "minus", "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    made = fill_middle.fill_in_middle(docs, with_text=True)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = []
    for i, text, _, _ in rows:
        t = text or ""
        n = len(t)
        code = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = t[:lo], t[lo:hi], t[hi:]
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, n, form, None if form == "plain" else lo, None if form == "plain" else hi - lo, sha(out), sha(t), out))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = sorted((tuple(r) for r in fill_middle.undo(made).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, _, _ in rows), key=repr)


def test_arrangements_are_permutations_of_descriptors():
    parts = fill_middle.split((fill_middle.TEXT, 10, 30), [12, 12])
    assert parts == [(0, 10, 12), (0, 12, 12), (0, 12, 30)]
    for form in ("psm", "spm"):
        assert fill_middle.restore(fill_middle.arrange(parts, form), form) == parts


def test_no_middles(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- urls


def plain_verdict(url, rules, unlisted):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, unlisted))
    return host, path, best[1], best[2]


URLS = [None, "", "example.org/es/", "http://Example.ORG/es/x", "http://example.org", "http://example.org?x=/es/", "http://example.org/en/10#/es/", "http://notexample.org/es/", "http://a.b.example.org/es/y?z",
        "http://.org/", "http://org/", "http://com/fr/", "http://x.com/de/a?b", "http://x.com/DE/", "a://b://c.org/", "http://É.org/é", "http:///es/", "http://x.net/de/", "http://org./", "http://" + "a." * 3000 + "org/" + "p" * 5000, "http://x.org//es/"]


@pytest.mark.parametrize("most_broadcast", [100_000, 0])
def test_urls_by_plain_python(spark, most_broadcast):
    pick = random.Random(1)
    urls = URLS + [f"http{'s' * (i % 2)}://{pick.choice(['', 'www.', 'm.x.'])}{pick.choice(['org', 'example.org', 'example.com', 'com', 'a.net'])}{pick.choice(['', '/', '/es/', '/en/1', '/en/12', '/fr/', '/de/q', '?q', '#f'])}" for i in range(300)]
    pages = spark.createDataFrame([(None if i % 50 == 7 else i // 2, u, "h", "r", 5) for i, u in enumerate(urls + urls[:30])], "page_id long, url string, html string, rule string, _row int").repartition(3)
    many = url_filter.RULES + [(f"h{k}.net", f"/{'p' * (k % 7)}", "block") for k in range(500)] + [("m.x.example.com", "/en/1", "allow"), ("A.net", "/", "block"), ("a.net", "/", "allow")]
    for rules in (url_filter.RULES, many):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = sorted(repr(tuple(r)) for r in url_filter.filter_urls(pages, table, most_broadcast=most_broadcast).collect())
        lowered = [(h.lower(), p, v) for h, p, v in rules]
        want = sorted(repr((r["page_id"], *plain_verdict(r["url"], lowered, "allow"))) for r in pages.collect())
        assert got == want


def test_false_hits_of_the_filter_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_A_KEY", 1)
    rules = spark.createDataFrame([(f"h{k}.net", "/", "block") for k in range(2000)], "host string, path string, verdict string")
    listed = rules.selectExpr("host || path AS key")
    bloom, blocks = url_filter.bloom_filter(listed, 2000)
    asked = spark.range(4000).selectExpr("concat('h', id, '.net/') AS key").withColumn("block", url_filter._block(url_filter.F.col("key"), blocks))
    passed = {r["key"] for r in asked.join(bloom, "block").where(url_filter.might_hold(url_filter.F.col("key"))).collect()}
    assert {f"h{k}.net/" for k in range(2000)} <= passed and len(passed) > 2000
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id, '.net/') AS url")
    blocked = {r["page_id"] for r in url_filter.filter_urls(pages, rules).where("verdict = 'block'").collect()}
    assert blocked == set(range(2000))


def test_empty_tables_of_urls(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, url_filter.production_rules(spark)).collect() == []
    pages = spark.createDataFrame([Row(page_id=1, url="http://a.org/")])
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, empty).collect()] == [(1, "a.org", "/", None, "allow")]
