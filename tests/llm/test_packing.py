import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from auctionlake.llm import packing
from auctionlake.llm.subwords import Subwords, vocabulary


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_id_once_in_full_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 9000 if seed else 40, rng.integers(1, 300)).tolist()
    tiers, got = (512, 1024, 2048, 4096), defaultdict(list)
    for size, inside in packing.plan(lengths, tiers):
        assert sum(n for _, _, n in inside) == size and size & (size - 1) == 0 and size <= 4096
        for doc, start, n in inside:
            got[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(got[doc]):
            assert start == at and m > 0
            at += m
        assert at == n


def test_long_documents_fill_whole_windows_first():
    assert packing.plan([4096 * 2], (512, 1024, 2048, 4096)) == [(4096, [(0, 0, 4096)]), (4096, [(0, 4096, 4096)])]


def test_step_groups_hold_one_size_and_even_cost():
    sequences = [(512, [(k, 0, 512 - k)]) for k in range(256)] + [(1024, [(0, 0, 1024)])] * 64
    groups, size = packing.steps(sequences, 65_536), {}
    for (s, _), g in zip(sequences, groups, strict=True):
        assert size.setdefault(g, s) == s
    cost = defaultdict(int)
    for (s, inside), g in zip(sequences, groups, strict=True):
        cost[s, g] += sum(n * n for _, _, n in inside)
    small = [c for (s, _), c in cost.items() if s == 512]
    assert max(small) < 1.02 * min(small)


def test_odd_rows(odd):
    whole, rows = Tokenizer.from_file(vocabulary()), packing.digest(packing.pack(odd, vocabulary(), 2, block_tokens=5000)).collect()
    ids = [whole.encode(r.text or "", add_special_tokens=False).ids + [2] for r in odd.collect()]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for doc in (1, 4, 8, 9):
        own = next(i for i, r in zip(ids, odd.collect(), strict=True) if r.doc_id == doc)
        for r in (r for r in rows if r.doc_id == doc):
            assert r.ids_crc32 == zlib.crc32(np.asarray(own[r.start:r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(own)
    assert packing.pack(odd.where("false"), vocabulary(), 2).count() == 0


def test_word_table_equals_the_library():
    coder, whole = Subwords(vocabulary(), kept=20), Tokenizer.from_file(vocabulary())
    for text in ("Don't STOP 'S 12ab!!?", "é Ångström İx ΣΣ", "a b c\x1cd\x85e", "<|ENDOFTEXT|> a <|endoftext|>b", " ".join(map(str, range(300)))):
        assert np.frombuffer(coder.text(text.encode()), coder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_plain_words_need_no_search_and_equal_the_library():
    coder, whole = Subwords(vocabulary()), Tokenizer.from_file(vocabulary())
    letters = [chr(c) for c in range(33, 0x250)]
    odd = ["e\u0301", "\u0391\u03a3.", "a_", "_a_", "a1.", "l's", "''s", "x's...", "\u2026", "a\u2026", "<|x", "a<|endoftext|>b", "\u212b", "a\u00adb"]
    for word in [*letters, *(c + end for c in letters for end in (".", "x'", "'s")), *odd]:
        assert np.frombuffer(coder.text(word.encode()), coder.dtype).tolist() == whole.encode(word, add_special_tokens=False).ids, word
    coder.pieces = coder.normalize = None
    for word in ("\u00c9t\u00e9,", "Plain", "plain!!", "stra\u00dfe"):
        assert np.frombuffer(coder.text(word.encode()), coder.dtype).tolist() == whole.encode(word, add_special_tokens=False).ids


def test_letters_before_marks_are_encoded_once(monkeypatch):
    coder, whole, met = Subwords(vocabulary()), Tokenizer.from_file(vocabulary()), []
    tokenize = coder.tokenize
    monkeypatch.setattr(coder, "tokenize", lambda piece: met.append(piece) or tokenize(piece))
    text = "zubrowska, zubrowska. Zubrowska!! (zubrowska) zubrowska NIÑOSKA... niñoska, niñoska"
    assert np.frombuffer(coder.text(text.encode()), coder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert met.count("zubrowska") <= 2 and len([x for x in met if x.startswith("ni")]) <= 2


@pytest.mark.parametrize("kept", [1, 2, 3, 7])
def test_full_tables_lose_no_word(kept):
    coder, whole = Subwords(vocabulary(), kept=kept), Tokenizer.from_file(vocabulary())
    text = "one, two. one two! three; Three é Éa éa, one? <|endoftext| 12 a1 one"
    for _ in range(3):
        assert np.frombuffer(coder.text(text.encode()), coder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(map(coder.one, text.encode().lower().split())), coder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(coder.words) <= kept and len(coder.older) <= kept
        coder.settle(1)
