import math
import textwrap
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from auctionlake.llm import decontaminate, licence_texts, licenses, urls


def test_decontamination_finds_whole_and_nearly_whole_items(spark, odd):
    item = " ".join(f"item{k}" for k in range(30))
    items = spark.createDataFrame([(1, item), (2, "x"), (3, None), (4, " "), (5, " ".join(f"Other{k}" for k in range(12)))], "item_id bigint, text string")
    near = item.split()
    near[29] = "changed"
    docs = [(1, "a b " + item.upper() + " c"), (2, " ".join(["q"] * 400) + " " + " ".join(near)), (3, " ".join(item.split()[:15])), (4, "y " * 50), (None, item), (6, "some x here")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    found = decontaminate.matches(frame, items)
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in found.collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (6, 2)}
    assert got[1, 1] == (2, 30, 1000) and got[2, 1][:2] == (400, 30) and 800 <= got[2, 1][2] < 1000 and got[6, 2] == (1, 1, 1000)
    assert sorted(r.doc_id for r in decontaminate.clean(frame, found).collect()) == [3, 4]
    assert decontaminate.matches(frame.where("false"), items).count() == 0 == decontaminate.matches(frame, items.where("false")).count()
    assert {r.doc_id for r in decontaminate.matches(odd, items).collect()} == {7}


def test_hamming_blocks_miss_nothing_within_the_radius(spark):
    prints = [(k, (0x9E3779B97F4A7C15 * k) % (1 << 63)) for k in range(1, 12)]
    flips = [(k, p ^ sum(1 << (b * 10 + k) % 63 for b in range(n))) for k, p in prints for n in (0, 1, 5, 14, 19)]
    items = spark.createDataFrame(prints, "item_id bigint, print bigint").withColumn("size", F.lit(9))
    windows = spark.createDataFrame([(k, p) for k, p in flips], "uid bigint, print bigint").withColumns({"start": F.monotonically_increasing_id(), "size": F.lit(9)})
    want = sum((p ^ q).bit_count() <= 19 for _, p in flips for _, q in prints)
    assert decontaminate.within(windows, items, 19).count() == want


def test_licence_rules_in_order(spark, odd):
    number = {x: k + 1 for k, x in enumerate(licenses.SENTENCES)}
    mit, tag, kept = (number[x] for x in ("released under the mit license", "spdx license identifier mit", "all rights reserved"))
    docs = [(1, "Text. Released under the MIT License.\nMore."), (3, "SPDX-License-Identifier: MIT\nAll rights reserved."), (4, "no licence"), (5, None), (5, ""), (None, "ALL RIGHTS RESERVED")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, numbers int")
    got = {(r.doc_id, r.licence): (r.sentences, r.first_sentence) for r in licenses.scan(frame).collect()}
    assert got == {
        (1, "MIT"): (str(mit), 1), (3, "MIT"): (f"{tag}|{kept}", 0), (3, "LicenseRef-all-rights-reserved"): (f"{tag}|{kept}", 1),
        (None, "LicenseRef-all-rights-reserved"): (str(kept), 0)}
    assert licenses.scan(odd).count() == 0 == licenses.scan(frame.where("false")).count()


def test_every_licence_sentence_is_normal_and_every_rule_has_a_cue():
    assert all(s == " ".join(s.split()) and all(c.isalnum() or c == " " for c in s) for s in licenses.SENTENCES)
    for _, ids in licenses.RULES:
        assert any(c in licenses.SENTENCES[n - 1] for n in ids for c in licenses.CUES)


def test_genuine_notices_wrapped_and_unwrapped(spark):
    """Every notice as published, by paragraph, in one line, as a comment, wrapped elsewhere, and behind a line without a stop."""
    forms, want = [], []
    for licence, _, text in licence_texts.NOTICES:
        flat = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        wrapped = "\n\n".join(textwrap.fill(p, 40) for p in flat.split("\n\n"))
        comment = "\n".join(f" * {line}".rstrip() for line in text.split("\n"))
        for form in (text, flat, " ".join(text.split()), comment, wrapped, "Copyright (c) 2020 Some Author\n" + text, text.replace("\n", "\r\n"), "word " * 50_000 + "\n" + text + "\nmore"):
            forms.append((len(forms), form))
            want.append(licence)
    got = {}
    for r in licenses.scan(spark.createDataFrame(forms, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    assert not [(want[k], forms[k][1][:60], got.get(k)) for k in range(len(forms)) if got.get(k) != {want[k]}]


def test_rules_do_not_bridge_what_another_took(spark):
    gpl = next(t for n, _, t in licence_texts.NOTICES if n == "GPL-3.0-or-later")
    first, *rest = licenses.sentences_of(gpl)
    text = f"{first}.\n\nReleased under the MIT License. {'. '.join(rest)}.\n\n{'. '.join([first, *rest])}."
    got = {(r.licence, r.first_sentence) for r in licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    assert got == {("GPL-3.0-or-later", 4), ("GPL-3.0-or-later", 0), ("MIT", 1)}


def test_url_rules_and_parts(spark):
    rows = [
        (1, "http://a.COM/x?y#z"), (2, "https://www.example.com/en/1"), (3, "https://m.example.com/en/1"), (4, "ftp://a.net/es/"), (5, "http://a.net/en/"), (6, "http://com"),
        (7, None), (8, "no scheme"), (9, ""), (10, "http://notcom.org/a/b?c://d"), (11, "http://x.net#/es/"), (5, "http://a.net/en/"),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(1, 12)] == [
        ("a.com", "/x", "com/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("m.example.com", "/en/1", "example.com/en/"), ("a.net", "/es/", "net/es/"),
        ("a.net", "/en/", None), ("com", "", None), ("", "", None), ("", "", None), ("", "", None), ("notcom.org", "/a/b", None), ("x.net", "", None)]
    assert [got[k].verdict for k in (1, 2, 3, 4)] == ["allow", "allow", "block", "block"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_url_models_equal_brute_force(spark):
    import zlib

    pages = [(k, f"http://{'good' if k % 2 else 'spam'}{k % 7}.{'com' if k % 2 else 'net'}/{'fr' if k % 2 == 0 else 'a'}/{k % 5}") for k in range(60)] + [(100 + k, f"http://site{k}.org/fr/{k}") for k in range(9)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string")).collect()}
    counts, kinds = defaultdict(Counter), defaultdict(set)
    text = lambda r: "\x02" * 3 + r.host + r.path + "\x03"
    for r in got.values():
        if r.rule and zlib.crc32((r.host + r.path).encode()) % 2 == 0:
            t = text(r)
            for i in range(3, len(t)):
                for k in range(4):
                    counts[r.verdict][t[i - k:i + 1]] += 1
                    kinds[r.verdict, t[i - k:i]].add(t[i])

    def chance(label, t, i):
        p = 1 / 256
        for k in range(4):
            c = t[i - k:i]
            follow = kinds[label, c]
            if follow:
                p = (counts[label][c + t[i]] + len(follow) * p) / (sum(counts[label][c + f] for f in follow) + len(follow))
        return p

    for r in got.values():
        t = text(r)
        ratios = [round(1000 * (math.log(chance("allow", t, i)) - math.log(chance("block", t, i)))) for i in range(3, len(t))]
        assert abs(r.score - sum(ratios) // len(ratios)) <= 1
    cut = [r.score for r in got.values() if r.verdict == "allow" and not r.rule]
    assert not cut or min(cut) > max([r.score for r in got.values() if r.verdict == "block" and not r.rule], default=-10**9)
