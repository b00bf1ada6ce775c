"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auctionlake.llm import periodic, quality, queries, variants

SF = "/root/testdata/sf0.001"


def differ(got, want):
    """The first rows that only one side has, shortened: long lists are not shown whole."""
    got, want = Counter(got), Counter(want)
    return [repr(x)[:300] for x in [*list((got - want))[:2], *list((want - got))[:2]]]


def brute_runs(w, least=12):
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start - q, i - start + q), q)
    return sorted((s, size, q) for (s, size), q in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=120), st.sampled_from([2, 5, 12]))
def test_runs_of_two_words(w, least):
    assert periodic.runs(w, least) == brute_runs(w, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(1, 40)), max_size=8), st.integers(1, 4))
def test_runs_in_runs(parts, times):
    w = [x for root, k in parts for x in root * k] * times
    assert periodic.runs(w[:900]) == brute_runs(w[:900])


def test_runs_of_long_loops_and_one_word():
    rng = random.Random(5)
    for _ in range(40):
        root = [b"%d" % rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 90))]
        w = [b"%d" % rng.randrange(50) for _ in range(rng.randrange(30))] + root * rng.randrange(2, 9) + root[: rng.randrange(len(root))]
        w += [b"z"] * rng.randrange(60) + root * rng.randrange(1, 4)
        assert periodic.runs(w) == brute_runs(w)
    assert periodic.runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs(([b"a"] * 40 + [b"b"]) * 3000)[0] == (0, 40, 1)
    assert (0, 123_000, 41) in periodic.runs(([b"a"] * 40 + [b"b"]) * 3000)


def contract(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_query_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((contract(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 9000), key=repr)
    got = [tuple(r) for r in queries.op12_periodic(spark, SF).collect()]
    ids = {r[0] for r in want}
    assert not differ((r for r in got if r[0] in ids), want) and len(got) == docs.count() and sum(r[1] for r in want) > 5


def test_periodic_of_odd_rows(spark, odd):
    want = sorted((contract(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 9), key=repr)
    got = [tuple(r) for r in periodic.digest(periodic.periodic_runs(periodic.with_loops(odd))).collect()]
    assert sorted((r for r in got if r[0] != 9), key=repr) == want and len(got) == odd.count()
    assert periodic.periodic_runs(odd.where("false")).count() == 0
    clash = odd.selectExpr("doc_id", "text", "1 as runs", "2 as collapsed", "3 as n_words")
    assert periodic.periodic_runs(clash).columns == ["doc_id", "n_words", "runs", "collapsed"] and periodic.periodic_runs(clash).count() == odd.count()


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


def brute_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def told(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_variants_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_variants(brute_vocabulary(docs)), key=repr)
    assert not differ(told(queries.op11_variants(spark, SF)), want) and sum(r[1] is not None for r in want) > 3


@pytest.mark.parametrize("block", [7, 4096])
def test_near_words_against_brute_force(spark, block):
    rng = random.Random(3)
    letters = "aÿ×"
    counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))): rng.choice([5, 5, 6, 25, 26, 125, 700]) for _ in range(400)}
    counts |= {"bbbbbb": 5, "bbbbbbb": 25, "bbbbbbbb": 125, "bbbbbbbbb": 625, "x" * 20_000: 5, "x" * 20_001: 30}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    near = {r.word: (r.n_near, r.best) for r in variants.near_words(words, block=block).collect()}
    want = {w: [v for v in counts if one_edit(w, v)] for w in counts if len(w) < 100}
    for w, vs in want.items():
        assert near.get(w, (0, None)) == (len(vs), min(vs, key=lambda v: (-counts[v], v), default=None))
    assert near["x" * 20_000] == (1, "x" * 20_001) and max(n for n, _ in near.values()) > 3
    if block == 4096:
        got = {r[0]: r for r in told(variants.variants(words))}
        assert got["bbbbbb"][2] == "bbbbbbbbb" and got["x" * 20_000][1] == "x" * 20_001
        assert not differ((r for w, r in got.items() if len(w) < 100), brute_variants({w: n for w, n in counts.items() if len(w) < 100}))


def test_vocabulary_adds_up_over_flushes(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(5, "Straße straße STRASSE großes Großes großes grosses " * 5), (None, "abcdefg " * 7)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, word string")
    for kept in (1, 200_000):
        got = {r.word: r.n for r in variants.vocabulary(docs, damage=199, kept=kept).collect()}
        assert got == brute_vocabulary(rows)
    assert variants.grouped(docs.where("false"), damage=199).count() == 0


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i:i + 3])].append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), base


def test_quality_against_brute_force(spark, odd):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(100 + k, " ".join(rng.choice(["the", "of", "🙂#", "a\nb", "x|y", " q", "z" * 9]) for _ in range(rng.randrange(300)))) for k in range(60)]
    rows += [(300, "a b c " * 40_000), (301, "line one\n" * 60), (302, "\n\n \n\x0bone\x0b\n")]
    got = quality.judge(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, failed int"))
    made = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()), key=repr)
    assert not differ(made, ((d, *brute_quality(t)) for d, t in rows))
    assert got.where("kept and (base_failed or failed <> '')").count() == 0 and quality.judge(odd.where("false")).count() == 0


def test_quality_query_keeps_clean_and_drops_marked_documents(spark):
    sf = "/root/testdata/sf0.01"
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(quality.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    made = queries.op13_quality(spark, sf)
    assert made.columns == names and not differ((tuple(r) for r in made.collect()), want)
    verdict = {r[0]: (r[6], r[7]) for r in want}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [verdict[d] for d, q in label.items() if q == 1 and not verdict[d][0]]
    bad = [verdict[d] for d, q in label.items() if q == 0 and not verdict[d][0]]
    assert sum(k for _, k in good) >= 0.99 * len(good) and sum(not k for _, k in bad) >= 0.5 * len(bad)


def test_rules_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "one two three " * 30 + " ".join(f"w{k}" for k in range(90)))], "doc_id bigint, text string")
    short = (quality.Rule("short", "word_chars", "n_words", 9_000, None),)
    assert [r.failed for r in quality.judge(docs, short).collect()] == ["short"]
    assert [r.kept for r in quality.judge(docs, ()).collect()] == [True]
