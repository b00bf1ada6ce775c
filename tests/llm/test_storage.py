import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from auctionlake.llm import queries, sharding, tokenfiles
from auctionlake.llm.subwords import vocabulary


@pytest.mark.parametrize("seed", range(4))
def test_codes_round_trip(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 1 << rng.choice([4, 9, 20, 32]), rng.integers(0, 50)).astype(np.uint32) for _ in range(40)]
    coded = [tokenfiles.encode(d) for d in docs]
    join = lambda k: np.frombuffer(b"".join(c[k] for c in coded), np.uint8)
    got = tokenfiles.decode(join(0), join(1), np.asarray([len(d) for d in docs]))
    assert got.tolist() == np.concatenate(docs).tolist()


def test_token_files_of_odd_rows(spark, odd):
    whole, back = Tokenizer.from_file(vocabulary()), tokenfiles.round_trip(spark, odd, vocabulary(), 1).orderBy("start").collect()
    want = Counter((r.doc_id, np.asarray(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in back) == want
    ids, start = [r.doc_id for r in back], 0
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    for r in back:
        assert r.start == start
        start += r.n_tokens
    assert tokenfiles.round_trip(spark, odd.where("false"), vocabulary(), 1).count() == 0


def test_matrix_rows_agree_with_both_margins():
    ends = np.cumsum([7, 0, 120, 3, 50]).tolist()
    rows = np.stack([sharding.matrix_row(ends, 8, 1, p) for p in range(5)])
    assert rows.sum(axis=1).tolist() == [7, 0, 120, 3, 50] and rows.sum(axis=0).tolist() == sharding.capacities(180, 8).tolist()


def test_shards_of_odd_rows(spark, odd):
    for rows, slot_rows in ((sharding.keyed(odd), 1_000_000), (odd, 2)):
        got = sharding.shard(rows, 4, slot_rows=slot_rows).collect()
        assert len(got) == 13
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    key = {(r.doc_id, r.size, r.text_crc32) for r in sharding.keyed(odd).collect()}
    assert (4, 16, 0) in key and (7, 17, zlib.crc32(b"x")) in key
    assert sharding.shard(sharding.keyed(odd).where("false"), 4).count() == 0


def test_query_exchanges_whole_documents(spark, odd, tmp_path, monkeypatch):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    taken, real = [], sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda rows, *a, **b: taken.append(rows.columns) or real(rows, *a, **b))
    got = queries.op3_sharding(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert taken == [["doc_id", "text", "lang", "shard"]] and plan.index("crc32") < plan.index("Window")
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got.collect()) == want


def test_shards_are_sliced_by_bytes(spark, odd):
    got = sharding.shard(odd, 4, slot_bytes=1000)
    assert "slice" in got._jdf.queryExecution().analyzed().toString()
    rows = got.collect()
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and len(own) in (3, 4)
    texts = lambda frame: Counter((r.doc_id, r.text, r.lang) for r in frame)
    assert texts(rows) == texts(odd.collect())


def test_shards_are_uniform(spark):
    got = sharding.shard(spark.range(0, 8000, 1, 7), 8, seed=9).groupBy("shard").agg({"id": "avg"}).collect()
    assert all(abs(r[1] - 4000) < 5 * 2310 / 1000**0.5 for r in got)
