import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from auctionlake.llm import embeddings, langid, packing, scoring
from auctionlake.llm.subwords import vocabulary


def prose(spark, n=160):
    """Texts of four made-up languages with endings of their own."""
    rng, rows = np.random.default_rng(1), []
    parts = {"en": "the ing tion er and", "de": "der ung ich und sch", "fr": "le eau ment é que", "es": "el ción ado ñ os"}
    for k in range(n):
        lang = sorted(parts)[k % 4]
        words = ["".join(rng.choice(parts[lang].split(), rng.integers(1, 4))) for _ in range(rng.integers(5, 90))]
        rows.append((k, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages_of_held_out_texts(spark, odd):
    docs = prose(spark).unionByName(odd.drop("shard").withColumn("doc_id", odd.doc_id + 1000))
    got = langid.identify(docs).withColumn("held", langid.held_out(docs.doc_id)).collect()
    assert len(got) == 173 and all(0 <= r.score <= 1 for r in got)
    assert langid.share_right((r.lang, r.lang_pred) for r in got if r.doc_id is not None and r.doc_id < 160 and r.held) >= 0.95
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert r.held == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = prose(spark)
    strange = ["12 34 a 56 78 90 11 22", "Ωραία ημέρα για έναν περίπατο στη θάλασσα", "日本語の文章はここにあります", "<td>1</td><td>2</td>", "zxqj kvwx qqzz jxkv wvxq"]
    more = spark.createDataFrame([(1000 + k, t, None) for k, t in enumerate(strange)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in langid.recognised(docs.unionByName(more)).collect()) == list(range(160))


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1, -1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w, b = langid.machine(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    rows = [(k, v, k % 2) for k, v in enumerate(base)]
    for k in range(300):
        v = base[k % 20] + rng.standard_normal(64) * 0.3 * rng.random()
        rows.append((100 + k, v, (k % 20) % 2))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1] * 3, 0)]
    odd = [(2000, None, 0), (2001, np.zeros(64), 0), (2002, [*base[0][:63], float("nan")], 0), (2003, [*base[0][:63], None], 0), (2004, base[0], None), (2005, [*base[0][:63], float("inf")], 0)]
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, v, lab in rows + odd], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(frame.withColumn("v", frame.label), block=64).collect()}
    unit, labels = np.stack([v / np.linalg.norm(v) for _, v, _ in rows]), np.asarray([x for *_, x in rows])
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    found, true = sum(got[i].n_links for i, *_ in rows), int(near.sum())
    assert all(got[i].n_links <= n for (i, *_), n in zip(rows, near.sum(axis=1), strict=True)) and found >= 0.999 * true
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[0].component_id == got[1000].component_id == got[1001].component_id == 0
    assert embeddings.near_vectors(frame.where("false")).count() == 0


def test_recall_at_exactly_the_least_cosine_in_one_large_label(spark, tmp_path):
    """3,000 pairs at cosine 0.93 (and a hair) in a label of 30,000, through ``near_vectors`` itself."""
    rng = np.random.default_rng(11)
    x, side, rest = (rng.standard_normal((n, 64)) for n in (3000, 3000, 24_000))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.930001 * x + (1 - 0.930001**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    every = np.vstack([x, y, rest]).astype(np.float32)
    pd.DataFrame({"vec_id": range(len(every)), "embedding": list(every), "label": 1}).to_parquet(tmp_path / "vectors.parquet")
    frame = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    assert frame.dtypes[1] == ("embedding", "array<float>")
    wide = every.astype(float)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    true = int(((wide[:3000] * wide[3000:6000]).sum(axis=1) >= 0.93).sum())
    found = embeddings.near_vectors(frame).where("vec_id < 3000 and n_links > 0 and component_id = vec_id").count()
    assert true > 2900 and 0.998 * true <= found <= true


@pytest.mark.parametrize("largest", [218, 100_000, 1_000_000])
def test_recall_does_not_fall_with_the_label(largest):
    least, blocks = 0.93, 2
    words, bound, codes = embeddings.chosen(64, blocks, min(1 / 8, 100 / largest), least, 0.001, 5)
    rng = np.random.default_rng(largest)
    x, side = (rng.standard_normal((4000, 64)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = least * x + (1 - least**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for k in range(codes):
        a, b = (embeddings.filters(m, blocks, words, bound, 5 + k) for m in (x, y))
        met |= [len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]
    assert (~met).mean() <= 0.002


def test_list_decoding_finds_all_filters():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((20, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    bound, (turn, parts) = embeddings.cap(24, 12**2, 10), embeddings.code(24, 2, 12, 7)
    for got, x in zip(embeddings.filters(v, 2, 12, bound, 7), v @ turn, strict=True):
        want = [a * 12 + b for a in range(12) for b in range(12) if x[:12] @ parts[0][a] + x[12:] @ parts[1][b] >= bound]
        assert got.tolist() == want


def fitted(ids, counts, steps=0):
    """A model trained on one text in this process."""
    model = scoring.start(np.asarray(counts))
    if steps:
        second = {k: np.zeros_like(v) for k, v in model.weights.items()}
        model.weights, _ = scoring.descend(model, second, np.r_[np.full(scoring.BEFORE + 1, model.end), ids], steps, np.random.default_rng(5))
    return model


@pytest.mark.parametrize("many", [30, 2000])
def test_gradients_agree_with_differences(many):
    rng = np.random.default_rng(0)
    model = fitted([], np.arange(many))
    w = model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = rng.integers(0, many, (3, scoring.WINDOW)), rng.integers(0, many, (3, scoring.WINDOW))
    _, g, met = scoring.gradients(model, x, y)
    whole = np.zeros_like(w["E"])
    whole[met] = g["E"]
    g["E"] = whole
    for k in w:
        for _ in range(4):
            at = (rng.choice(met), rng.integers(scoring.WIDTH)) if k == "E" else tuple(rng.integers(0, s) for s in w[k].shape)
            kept = w[k][at]
            if kept < -1e3:  # a place without an id
                assert g[k][at] == 0
                continue
            w[k][at] = kept + 1e-5
            up = scoring.gradients(model, x, y)[0]
            w[k][at] = kept - 1e-5
            down = scoring.gradients(model, x, y)[0]
            w[k][at] = kept
            assert (up - down) / 2e-5 == pytest.approx(g[k][at], abs=2e-4)


def plain_log_probabilities(model, ids):
    """ln P of each id of one text and its end, place by place: loops over the keys it may attend to, and over all ids as outcomes."""
    w, end, text = model.weights, model.end, [*ids, model.end]
    row = [end] * (scoring.BEFORE + 1) + text
    out = []
    for k in range(len(text)):
        first = k // scoring.STRIDE * scoring.STRIDE  # where the id's window begins
        seen = row[first:k + scoring.BEFORE + 1]
        e = [w["E"][t] + w["P"][at] for at, t in enumerate(seen)]
        q, keys, values = (e[-1] @ w["A"])[:16], [(x @ w["A"])[16:32] for x in e], [(x @ w["A"])[32:] for x in e]
        weights = [math.exp(min(30, max(-30, float(q @ key)))) for key in keys]
        h = e[-1] + sum(a * v for a, v in zip(weights, values, strict=True)) / sum(weights)
        r = np.maximum(h @ w["B"] + w["b"], 0)
        firsts = [math.exp(z) for z in r @ w["C"] + w["c"]]
        own = int(model.classes[text[k]])
        p = firsts[own] / sum(firsts)
        if own < scoring.SETS:
            places = [math.exp(r @ w["D"][own][:, s] + w["d"][own][s]) for s in range(scoring.SIZE)]
            p *= places[model.slots[text[k]]] / sum(places)
        else:
            p *= math.exp(model.inside[text[k]])
        out.append(math.log(p))
    return out


def test_windows_agree_with_attention_place_by_place():
    rng = np.random.default_rng(2)
    many = 2500
    model = fitted(rng.integers(0, many - 1, 3000), np.arange(many) // 3, steps=5)
    lengths = np.asarray([0, 1, 23, 24, 25, 90])
    ids = rng.integers(0, many - 1, lengths.sum())
    want = [p for n, e in zip(lengths, np.cumsum(lengths), strict=True) for p in plain_log_probabilities(model, ids[e - n:e].tolist())]
    assert np.allclose(scoring.log_probabilities(model, ids, lengths, most=3), want, rtol=1e-4, atol=1e-4)


def test_each_id_is_scored_once_from_what_stands_before_it():
    rng = np.random.default_rng(0)
    model = fitted(rng.integers(0, 30, 400), np.ones(31, np.int64), steps=3)
    lengths = np.asarray([0, 1, 23, 24, 25, 100])
    ids = rng.integers(0, 30, lengths.sum())
    got = scoring.log_probabilities(model, ids, lengths)
    assert len(got) == (lengths + 1).sum()
    alone = np.concatenate([scoring.log_probabilities(model, ids[e - n:e], np.asarray([n])) for n, e in zip(lengths, np.cumsum(lengths), strict=True)])
    assert np.allclose(got, alone, atol=1e-5)
    other = ids.copy()
    other[-1] = (other[-1] + 1) % 30
    assert np.allclose(scoring.log_probabilities(model, other, lengths)[:-2], got[:-2], atol=1e-5)
    total = sum(math.exp(scoring.log_probabilities(model, np.asarray([*ids[:5], k]), np.asarray([6]))[5]) for k in range(30))
    assert total + math.exp(scoring.log_probabilities(model, ids[:5], np.asarray([5]))[5]) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("many", [31, 1600, 4000])
def test_chances_of_all_ids_add_up_to_one(many):
    rng = np.random.default_rng(4)
    model = fitted(rng.integers(0, many - 1, 2000), np.arange(many)[::-1] ** 2, steps=4)
    r = np.abs(rng.standard_normal((1, scoring.HIDDEN))).astype(np.float32)
    assert np.exp(scoring.chances(model, np.repeat(r, many, axis=0), np.arange(many)).astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_attention_learns_from_every_training_document(spark, tmp_path):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(k, " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(12))) for k in range(700)], "doc_id bigint, text string")
    source = docs.select("doc_id", scoring.held_out(docs.doc_id).alias("held"), docs.text.cast("binary").alias("text"))
    scoring.blocks_of(source, vocabulary(), 9000).write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    counts = scoring.subword_counts(blocks, vocabulary())
    model = scoring.fit(blocks, vocabulary(), counts, rounds=2, steps=60)
    moved = (model.weights["E"] != scoring.start(counts).weights["E"]).any(axis=1)
    assert blocks.count() > 2 and moved[counts > 0].mean() > 0.98 and not moved[counts == 0].any()


def test_every_training_id_is_learned_from(monkeypatch):
    ids, met, gradients = np.arange(1, 20_001), [], scoring.gradients
    model = scoring.start(np.ones(20_002, np.int64))
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    monkeypatch.setattr(scoring, "gradients", lambda model, x, y: met.append(y.ravel()) or gradients(model, x, y))
    for turn in range(3):
        scoring.descend(model, second, np.r_[0, ids], 1, np.random.default_rng(5), turn, 3)
    assert set(np.concatenate(met)) == set(ids) and sum(map(len, met)) < 22_000


def test_few_training_ids_are_learned_from_too(spark):
    docs = spark.createDataFrame([(k, "some words") for k in range(2)], "doc_id bigint, text string")
    source = docs.select("doc_id", scoring.F.lit(False).alias("held"), docs.text.cast("binary").alias("text")).coalesce(1)
    blocks = scoring.blocks_of(source, vocabulary(), 1)
    counts = scoring.subword_counts(blocks, vocabulary())
    model = scoring.fit(blocks, vocabulary(), counts, rounds=1, steps=2)
    assert (model.weights["E"] != scoring.start(counts).weights["E"]).any(axis=1)[counts > 0].all()


def test_score_of_held_out_documents_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = scoring.score(docs, vocabulary()).where("held_out").selectExpr("sum(score) / sum(n_tokens) as score", "sum(base_score) / sum(n_tokens) as base").first()
    assert held.score > held.base


def test_score_is_the_attention_models_own(spark):
    docs = prose(spark, 60).select("doc_id", "text").coalesce(1)
    got = {r.doc_id: r.score for r in scoring.score(docs, vocabulary()).collect()}
    source = docs.select("doc_id", scoring.held_out(docs.doc_id).alias("held"), docs.text.cast("binary").alias("text"))
    blocks = scoring.blocks_of(source, vocabulary(), 12 << 20)
    model = scoring.fit(blocks, vocabulary(), scoring.subword_counts(blocks, vocabulary()))
    coder = scoring.subwords(vocabulary())
    for r in docs.collect():
        ids = np.frombuffer(b"".join(coder.one(w) for w in r.text.encode().lower().split()), coder.dtype).astype(np.int64)
        assert got[r.doc_id] == pytest.approx(float(scoring.log_probabilities(model, ids, np.asarray([len(ids)])).sum()) / math.log(10), rel=1e-3)


def test_scores_of_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(prose(spark, 40).selectExpr("doc_id + 100 as doc_id", "text")).withColumn("score", scoring.F.lit("clash"))
    got = scoring.score(docs, vocabulary(), block_bytes=2000).collect()
    counts, tokens = Counter(), []
    for r in docs.collect():
        words = [*(r.text or "").encode().lower().split(), b""]
        held = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2
        tokens.append((r.doc_id, held, words))
        if not held:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, held, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)) for d, held, w in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert scoring.score(docs.where("false"), vocabulary()).count() == 0


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    item = " ".join(f"exam{k}" for k in range(25))
    docs = prose(spark).collect()
    extra = [(500, docs[0].text, "de"), (500, docs[0].text, "de"), (501, docs[4].text + " " + item, "de"), (502, "12 34", "en"), (503, None, "en"), (504, docs[8].text + " zusatz", "de")]
    frame = spark.createDataFrame([tuple(r) for r in docs] + extra, "doc_id bigint, text string, lang string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "packing"]
    from test_minhash import brute

    lettered = [(r[0], r[1]) for r in [tuple(d) for d in docs] + extra if r[1] and any(c.isalpha() for c in r[1])]
    keep = {d for d, (_, _, kept) in brute(sorted(set(lettered)), 5, 80).items() if kept} - {501}
    assert {r.doc_id for r in pieces} == keep
    whole = packing.pack(frame.where(frame.doc_id.isin(list(keep))).dropDuplicates(), vocabulary(), 2).groupBy().sum("length").first()[0]
    assert sum(r.length for r in pieces) == whole
