"""Documents whose ids are null or repeat, and whose checksums collide, are not taken for one another."""

import zlib

import corpus_pipeline
from auctionlake.llm import decontaminate, minhash

ONE, TWO = "plumless", "buckeroo"
LONG = " ".join(f"w{k}" for k in range(60))


def test_colliding_texts_are_kept_apart(spark):
    assert zlib.crc32(ONE.encode()) == zlib.crc32(TWO.encode())
    docs = spark.createDataFrame([(None, ONE), (None, TWO), (7, ONE + " x"), (7, TWO + " y"), (7, LONG)], "doc_id bigint, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.text for r in kept.collect()) == sorted([ONE, TWO, ONE + " x", TWO + " y", LONG])
    items = spark.createDataFrame([(1, ONE)], "item_id bigint, text string")
    found = decontaminate.matches(docs, items)
    assert sorted(r.text for r in decontaminate.clean(docs, found).collect()) == sorted([TWO, TWO + " y", LONG])


def test_one_row_of_each_group_stays(spark):
    near = LONG + " end"
    rows = [(None, LONG), (None, near), (None, LONG), (5, LONG), (5, near), (5, "other text of the same id"), (9, near), (None, None), (None, ""), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, row_key string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [r for r in got if r[1] in (LONG, near)] in ([(5, LONG)], [(5, near)])
    assert [r for r in got if r[1] not in (LONG, near)] == sorted([(5, "other text of the same id"), (None, None), (None, ""), (3, None)], key=repr)
    groups = minhash.near_duplicates(docs, width=5, percent=80, bands=36, rows=5).collect()
    assert len(groups) == len(rows) and {r.component_id for r in groups if r.n_shingles > 50} == {5}
    only = spark.createDataFrame([(None, LONG), (None, near), (None, "another")], "doc_id bigint, text string")
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, only, "").collect())[0] == "another"
    assert corpus_pipeline.near_dedup(spark, only, "").count() == 2
    assert corpus_pipeline.near_dedup(spark, only.where("false"), "").count() == 0
