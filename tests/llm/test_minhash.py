import random
from itertools import combinations

import pytest

from auctionlake.llm import minhash
from auctionlake.llm.components import components


def brute(rows, width, percent):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "bands", "rows"), [(3, 85, 30, 6), (5, 80, 36, 5)])
def test_equals_brute_force(spark, width, percent, bands, rows):
    rng, texts = random.Random(width), []
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    for k in range(25):
        base = rng.choices(words, k=rng.randint(2, 160))
        if k % 3 == 0:
            base = passage.split() + base
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):  # chains of copies with a few changes, around the threshold
            base = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            texts.append(" ".join(base))
    docs = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), width=width, percent=percent, bands=bands, rows=rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(docs, width, percent)


def test_large_groups_in_small_blocks(spark):
    base = [f"v{k}" for k in range(300)]
    docs = [(k, " ".join(base[:k] + ["x"] + base[k + 1:])) for k in range(60)] + [(100 + k, " ".join(base[:200] + [f"z{k}"] * 9)) for k in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(docs, 3, 85)


def test_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 13
    by = {r.doc_id: r for r in got}
    assert [(by[d].n_shingles, by[d].component_id, by[d].kept) for d in (1, 2, 3, 4, 5, 6, 7)] == [
        (20, 1, True), (20, 1, False), (21, 1, False), (0, 4, True), (0, 5, True), (0, 6, True), (1, 7, True)]
    null = sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles)
    assert null == [(20, 1, False)]
    assert minhash.near_duplicates(odd.where("false")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
