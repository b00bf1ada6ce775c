"""Memory of Python workers: what stays between stages, and how much a group of sets holds."""

import pandas as pd
import pyarrow as pa

from auctionlake.llm import langid, minhash, packing
from auctionlake.llm.subwords import subwords, vocabulary


class Kept:
    """Stands for a table and keeps the function that its tasks would run."""

    def mapInArrow(self, run, shape):
        return run


def test_stages_let_go_of_tables_of_others(spark):
    subwords(vocabulary()).text(b"some words")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "row_key": ["a"], "text": [b"one two three four"]})
    list(minhash.signatures(Kept(), 3, 30, 6, 11)(iter([batch])))
    assert subwords.cache_info().currsize == 0 and minhash.word_hashes.cache_info().currsize == 1
    langid.predictor([]).func(pd.Series(["a"]))
    assert minhash.word_hashes.cache_info().currsize == 0


def test_waiting_workers_hold_few_words(spark, monkeypatch):
    class Task(Kept):
        def select(self, *columns):
            return self

        def get(self):
            return self

        def partitionId(self):
            return 0

    monkeypatch.setattr(packing, "TaskContext", Task())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(f"{chr(97 + k % 26)}{k}" for k in range(90_000)).encode()]})
    list(packing.pack(Task(), vocabulary(), 2)(iter([batch])))
    coder = subwords(vocabulary())
    assert 0 < len(coder.words) <= 60_000 and b"a0" in coder.words and not coder.older and not coder.parts


def test_long_sets_are_dealt_to_groups_by_their_size(spark):
    rows = [(1, n, 200_000) for n in range(40)] + [(2, n, 10) for n in range(40)]
    found = spark.createDataFrame(rows, "a long, b long, n_b long").groupBy("a").agg(minhash.parts("*", "n_b", 256, 1 << 19).alias("d"))
    assert dict(map(tuple, found.collect())) == {1: 16, 2: 1}


def test_small_groups_lose_no_link(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[k // 3:k // 3 + 120] + [f"x{k}"])) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()}
    parts = minhash.parts
    monkeypatch.setattr(minhash, "parts", lambda rows, sizes, block, most: parts(rows, sizes, 4, 500))
    assert {tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()} == whole
    assert {c for _, c, _ in whole} == {0}
