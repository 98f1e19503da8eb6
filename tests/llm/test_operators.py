"""Each numbered operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from findgrid.llm import knn, langid, licences, mixing, packing, passages, quality, queries, suffixes, tokencounts, toxicity
from findgrid.llm.tokens import WordIds

SF = "/root/testdata/sf0.01"

SCHEMA = "doc_id long, text string, lang string, source string, size long, kept string, row string"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", lambda k: "en")(i), more.get("source", lambda k: "s1")(i), 7, "k", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h", "x " * 3000, "Straße ÀÉ 日本語\n\n| a | b |", "same text here", "same text here"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def repeated(ws):
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)})


def test_quality_counts(spark):
    r = random.Random(1)
    texts = [*EDGE, *(" ".join(r.choice("abc") for _ in range(r.randint(5, 60))) for _ in range(40)), "l1\nl1\n\nl2 *\nl1"]
    got = {x.doc_id: x for x in quality.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        n = repeated(w)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n), t
        assert got[i].base_failed == (len(w) < 20 or 100 * n > 30 * len(w))
        assert not (got[i].kept and got[i].base_failed)


def test_quality_keep_carries_clashing_columns(spark):
    good = "the cat of the house is in the garden and it was by the tree with a bird from the town on that day"
    kept = quality.keep(docs(spark, [good, None, good])).collect()
    assert [(r.doc_id, r.kept, r.size) for r in kept] == [(0, "k", 7), (2, "k", 7)]
    assert quality.keep(docs(spark, [])).count() == 0


def test_language(spark):
    vocab = {"en": "the house and that with from thing", "fr": "la maison que dans pour avec être", "de": "das haus und nicht mit für eine"}
    r = random.Random(2)
    make = lambda k: " ".join(r.choice(vocab[k].split()) for _ in range(40))
    langs = [("en", "fr", "de")[i % 3] for i in range(60)]
    d = docs(spark, [make(k) for k in langs], lang=lambda i: langs[i])
    learnt = langid.learn(d.filter("doc_id < 30"), per_lang=8)
    assert sorted(learnt) == ["de", "en", "fr"]
    got = langid.identify(d.filter("doc_id >= 30"), learnt).collect()
    assert all(x.lang_pred == langs[x.doc_id] and 0 <= x.score <= 1 for x in got)
    odd = langid.identify(docs(spark, [None, "", "123 ½ !!", "la maison"]), learnt).orderBy("doc_id").collect()
    assert [x.lang_pred for x in odd] == ["und", "und", "und", "fr"]
    assert [x.lang_pred for x in langid.identify(docs(spark, ["abc"]), {}).collect()] == ["und"]
    assert langid.learn(docs(spark, [])) == {}
    assert langid.identify(docs(spark, []), learnt).count() == 0
    # a rare label cuts no other dictionary, long texts are read to their end
    more = d.unionByName(docs(spark, ["zzz yyy", "xxx"], lang=lambda i: "it").withColumn("doc_id", F.col("doc_id") + 900))
    assert {k: v for k, v in langid.learn(more.filter("doc_id < 30 OR doc_id >= 900"), per_lang=8).items() if k != "it"} == learnt
    long = langid.identify(docs(spark, ["the house " * 20 + make("fr") * 300, "neverseen " * 900 + "la maison que", "neverseen"]), learnt, ("doc_id", "size")).orderBy("doc_id").collect()
    assert [x.lang_pred for x in long[:2]] == ["fr", "fr"] and long[0].size == 7


def test_language_held_out(spark):
    rows = {x.doc_id: x.lang for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [x for x in queries.op2_language_id(spark, SF).collect() if x.held_out and x.lang_pred != "und" and rows[x.doc_id]]
    right = sum(x.lang_pred == rows[x.doc_id] for x in got) / len(got)
    print(f"language: {right:.4f} of {len(got)} held-out documents")
    assert right > 0.95


def test_word_ids_equal_the_tokenizer():
    texts = ["It's 12,5 don't. ÀB, İst ΑΣ. ﬁ x́.", "<|endoftext|> hi\tx 's, n't!", "ab<|endoftext|>Cd.<|STARTOFTEXT|>, <|startoftext|>!", "", None, "a" * 50, "日本語。テスト 12３ ①.", "İ. don't can't've A1b2-c_d é. e\u0301. x=\u0338 <|", " lead\u00a0and\u3000tail "]
    r = random.Random(3)
    texts += [" ".join(r.choice(["Ab,", "ab", "c.", "d;e", "ß:", "<|endoftext|>,"]) for _ in range(20)) for _ in range(20)]
    for special in (False, True):
        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        t.encode_special_tokens = special
        ids = WordIds(most=6, special_as_text=special)
        for at_once in (7, 30, 1 << 20):
            for got, x in zip(ids.many(texts, at_once=at_once), texts, strict=True):
                assert got.tolist() == (t.encode(x, add_special_tokens=False).ids if x else [])


def test_word_ids_of_control_characters():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"a{chr(c)}b {chr(c)} Cd.{chr(c)}\u3000x{chr(c)}" for c in [*range(33), *range(127, 161), 0x1680, 0x180E, 0x200B, 0x2028, 0xFEFF]]
    for got, x in zip(WordIds().many(texts), texts, strict=True):
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids


def test_word_ids_refuse_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError):
        WordIds("byte_bpe_50k.json")


def test_packing(spark):
    r = random.Random(4)
    texts = [None, "", "a", *(" ".join(r.choice(["word", "other", "x", "thing"]) for _ in range(r.randint(1, 70))) for _ in range(120)), "b " * 300]
    d = docs(spark, texts)
    d = d.unionByName(d.filter("doc_id IN (5, 6)"))
    p = packing.pack(d, capacity=64).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in enumerate(texts):
        ids = (t.encode(text, add_special_tokens=False).ids if text else []) + [2]
        mine = p[p.doc_id == i].sort_values("start").drop_duplicates("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == len(ids)
        for x in mine.itertuples():
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
    g = p.sort_values(["sequence_id", "offset"])
    for _, s in g.groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert sorted(g.sequence_id.unique()) == list(range(g.sequence_id.nunique()))
    assert len(p[p.doc_id == 5]) == 2 * len(p[p.doc_id == 5].drop_duplicates("start"))
    assert packing.pack(docs(spark, [])).count() == 0
    none = packing.pack(spark.createDataFrame([(None, "a b c", "x"), ((1 << 62) + 1, None, "y")], "doc_id long, text string, length string")).collect()
    assert sorted((str(x.doc_id), x.length) for x in none) == [("4611686018427387905", 1), ("None", 4)]


@pytest.mark.parametrize("histogram", [{1: 1_000_000}, {100: 100_000}, {k: 1000 for k in range(100, 110)}, {1500: 7, 2600: 9, 40: 5000}, {k: 3 for k in range(1, 4097)}])
def test_histogram_packing_leaves_little_room(histogram):
    s = packing.pack_histogram(histogram, 4096)
    last = 0
    for length, first, copies, base in zip(s.length, s.first, s.copies, s.base, strict=True):
        later = s.first[(s.length == length) & (s.first > first)]
        pieces = int((later.min() if len(later) else histogram[int(length)]) - first)
        last = max(last, int(base) + pieces // int(copies))
    tokens = sum(k * n for k, n in histogram.items())
    assert len(s.length) <= 4 * len(histogram) + 4 and tokens / (4096 * last) > 0.95


def test_histogram_packing_places_every_piece_once():
    r = random.Random(5)
    for _ in range(50):
        h = {r.randint(1, 100): r.randint(1, 50) for _ in range(20)}
        s = packing.pack_histogram(h, 100)
        fill = {}
        for length, first, copies, base, at in zip(*s, strict=True):
            same = [k for k in range(len(s.length)) if s.length[k] == length and s.first[k] > first]
            n = (min(s.first[k] for k in same) if same else h[length]) - first
            assert n % copies == 0
            for q in range(n):
                fill.setdefault(base + q // copies, []).append((at + q % copies * length, length))
        assert sum(map(len, fill.values())) == sum(h.values())
        for x in fill.values():
            x.sort()
            assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= 100


def all_maximal(s):
    """All maximal scoring segments by their definition: the best one (leftmost, shortest), then those of both sides."""
    best = max(((sum(s[a:b]), -a, a - b, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    x, _, _, a, b = best
    return [*all_maximal(s[:a]), (a, b, x), *((p + b, q + b, y) for p, q, y in all_maximal(s[b:]))]


def test_segments_against_brute_force():
    r = random.Random(6)
    for _ in range(1500):
        n = r.randint(1, 14)
        s = [r.choice([-2.3, -1.0, 1.1, 2.7, 3.05, 0.6]) + r.random() * 1e-3 for _ in range(n)]
        s = [-1.0 if x < -0.9 and x > -1.1 else x for x in s]
        got = toxicity.segments([(i, x) for i, x in enumerate(s) if x != -1.0], n, -1.0)
        want = all_maximal(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [x for _, _, x in got] == pytest.approx([x for _, _, x in want])


@pytest.mark.parametrize("gap", [-1.0, -10.0, -0.001])
def test_segments_take_linear_time(gap):
    t = time.process_time()
    got = toxicity.segments([(3 * i, 3.0 - 1e-6 * i) for i in range(200_000)], 600_000, gap)
    assert got and time.process_time() - t < 10


def test_extreme_value_constant():
    r = np.random.default_rng(7)
    n, lam, k = r.integers(50, 5000, 4000).astype(float), 0.8, 0.05
    s = np.log(k * n / r.exponential(size=4000)) / lam  # K n exp(-lambda S) is a unit exponential
    assert toxicity._constant(n, s, lam, -50.0) == pytest.approx(k, rel=0.05)
    assert toxicity._constant(n, np.where(s < 3, 0.0, s), lam, 3.0) == pytest.approx(k, rel=0.1)


def test_toxicity(spark):
    r = random.Random(7)
    plain = [f"w{c}{d}" for c in "abcdefghij" for d in "abcdefghij"]
    rows = []
    for i in range(400):
        t = [r.choice(plain) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for k in range(4):
                t[20 + 2 * k] = r.choice(["nastiest", "vilewords"])
        rows.append((i, " ".join(t), int(bad), "x"))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    m = toxicity.fit(d.select("doc_id", "text").unionByName(d.limit(9).select("doc_id", "text")), d.filter("doc_id % 4 <> 0"))
    got = toxicity.scan(d.filter("doc_id % 4 = 0"), m, ("doc_id", "toxic"), passages=True).collect()
    assert all(x.predicted == x.toxic for x in got)
    assert all(x.passages[0].start >= 15 and x.passages[0].end <= 32 for x in got if x.toxic)
    odd = toxicity.scan(docs(spark, [None, "", "nastiest " * 50_000, "nastiest vilewords nastiest"]).unionByName(docs(spark, [""])), m).orderBy("doc_id").collect()
    assert [x.predicted for x in odd] == [0, 0, 0, 1, 1] and all(0 <= x.score <= 1 for x in odd)
    assert toxicity.scan(docs(spark, []), m).count() == 0
    nothing = toxicity.fit(d, d.limit(0))
    assert toxicity.scan(docs(spark, ["a"]), nothing).first().predicted == 0
    one = toxicity.fit(d, d.filter("toxic = 0").withColumn("toxic", F.when(F.col("doc_id") > 5, F.col("toxic"))))
    assert toxicity.scan(docs(spark, ["a"]), one).first().predicted == 0


def test_licences(spark):
    r = random.Random(8)
    noise = [" ".join(r.choice("the cat mit runs over house of der und license plate".split()) for _ in range(12)) for _ in range(30)]
    texts = [*noise, "intro line\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.", "x\n\nLicensed under CC BY-NC 4.0.", None, ""]
    d = docs(spark, texts)
    m = licences.train(d)
    got = {(x.doc_id, x.paragraph, x.family) for x in licences.scan(d, m).collect() if x.confirmed}
    assert got == {(30, 2, "apache-2.0"), (31, 1, "mit"), (32, 3, "cc-by-nc")}
    assert licences.scan(docs(spark, []), m).count() == 0
    # equal rows are scanned each by itself
    two = licences.scan(docs(spark, ["Released under the MIT License."]).unionByName(docs(spark, ["Released under the MIT License."])), m).collect()
    one = licences.scan(docs(spark, ["Released under the MIT License."]), m).collect()
    assert two == one * 2


def test_licences_held_out(spark):
    """Templates with words left out and put around, in documents of given texts that the model hasn't seen, and those texts alone."""
    r = random.Random(23)
    given = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 300").orderBy("doc_id").limit(400).collect()]
    m = licences.train(docs(spark, given[:200]))
    plain = [t for t in given[200:] if not re.search("licen|rights|copyright|spdx|permi", t.lower())]
    made = []
    for family, statements in licences.TEMPLATES.items():
        for s in statements:
            if len(s.split()) > 5:
                for _ in range(3):
                    words = s.split()
                    del words[r.randrange(len(words))]
                    around = r.choice(plain).split()[:12]
                    made.append((family, " ".join([*around[:6], *words, *around[6:]])))
    got = licences.scan(docs(spark, [t for _, t in made] + plain), m).collect()
    found = {(x.doc_id, x.family) for x in got if x.confirmed}
    right = sum((i, f) in found for i, (f, _) in enumerate(made))
    wrong = sum(i >= len(made) or made[i][0] != f for i, f in found)
    print(f"licences: recall {right}/{len(made)}, precision {len(found) - wrong}/{len(found)}, {len(plain)} plain documents")
    assert right > 0.85 * len(made) and wrong <= 0.08 * len(found)


def test_licences_wrapped(spark):
    r = random.Random(8)
    noise = [" ".join(r.choice("the cat mit runs over house of der und license plate".split()) for _ in range(12)) for _ in range(30)]
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    mit = " * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation files"
    bsd = "// Redistribution and use in source and binary\n// forms, with or without\n// modification, are permitted provided that"
    own = "\n".join("plain words of a text that goes on" for _ in range(40))
    texts = [*noise, gpl, f"/*\n * Copyright someone\n *\n{mit}\n */", f"x\n\n{bsd}", f"{own}\n{mit}\n{own}\n{bsd}"]
    d = docs(spark, texts)
    got = {(x.doc_id, x.family) for x in licences.scan(d, licences.train(d)).collect() if x.confirmed}
    assert got == {(30, "gpl-3.0"), (31, "mit"), (32, "bsd"), (33, "mit"), (33, "bsd")}


def test_token_counts(spark, tmp_path):
    r = tokencounts.Rollup(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), tokencounts.BATCH)
    get = lambda: sorted((str(x.source), x.docs, x.tokens) for x in r.totals().collect())
    assert get() == []
    assert r.apply(1, rows(("put", 1, "t", "a", "en", 10), ("put", 2, "t", None, "en", 5), ("put", 3, "t", "a", "en", 1), ("put", 3, "t", "a", "en", 2)))
    assert get() == [("None", 1, 5), ("a", 2, 12)]
    again = rows(("put", 1, "t", "b", "en", 11), ("delete", 3, "t", None, None, 0), ("delete", 9, "t", None, None, 0))
    assert r.apply(2, again) and get() == [("None", 1, 5), ("b", 1, 11)]
    assert not r.apply(2, again) and get() == [("None", 1, 5), ("b", 1, 11)]
    assert r.apply(5, rows(("put", 3, "t", "b", "en", 4))) and get() == [("None", 1, 5), ("b", 2, 15)]
    with pytest.raises(ValueError):
        r.apply(3, rows(("put", 3, "t", "b", "en", 7)))
    r.compact()
    r.compact()
    assert get() == [("None", 1, 5), ("b", 2, 15)] and not r.apply(5, again) and not r.apply(2, again)
    assert r.apply(6, rows(("delete", 3, "t", None, None, None), ("put", None, "t", "z", "en", 9), ("put", 7, None, "z", "en", 9), ("other", 7, "t", "z", "en", 9), ("put", 8, "t", "c", "en", None)))
    assert get() == [("None", 1, 5), ("b", 1, 11), ("c", 1, 0)]
    # of equal counts the greatest source, whatever the order
    for k, part in ((7, 1), (8, 3)):
        assert r.apply(k, rows(("put", 20, "t", "p", "en", 3), ("put", 20, "t", "q", "en", 3), ("put", 20, "t", "o", "en", 3)).repartition(part))
        assert get()[-1] == ("q", 1, 3)


def test_token_counts_against_a_plain_ledger(spark, tmp_path):
    r, know = random.Random(18), {}
    roll = tokencounts.Rollup(spark, str(tmp_path), compact_every=2)
    for batch in range(1, 6):
        rows = [(r.choice(["put", "put", "delete"]), d, r.choice("tu"), r.choice(["a", "b", None]), "en", r.randint(0, 9)) for d in r.sample(range(30), 12)]
        assert roll.apply(batch, spark.createDataFrame(rows, tokencounts.BATCH))
        assert not roll.apply(batch, spark.createDataFrame(rows, tokencounts.BATCH))
        for op, d, t, s, lang, n in rows:
            know.pop((d, t), None)
            if op == "put":
                know[d, t] = (s, lang, n)
    want = {}
    for (_, t), (s, lang, n) in know.items():
        x = want.setdefault((s, lang, t), [0, 0])
        x[0] += 1
        x[1] += n
    assert {(x.source, x.lang, x.tokenizer): [x.docs, x.tokens] for x in roll.totals().collect()} == want


def test_mixing(spark):
    assert mixing.targets({"a": 10, "b": 10, None: 80}) == pytest.approx({"a": 30, "b": 30, None: 40})
    r = random.Random(9)
    texts = [" ".join(["w"] * r.randint(0, 30)) for _ in range(900)]
    d = docs(spark, [*texts, None], source=lambda i: None if i % 7 == 0 else f"s{i % 3}")
    d = d.unionByName(d.filter("doc_id < 30"))
    one, two = (mixing.mix(d).select("doc_id", "row.source", "size", "source_size", "target", "copies", "taken").toPandas() for _ in range(2))
    key = ["doc_id", "taken"]
    assert one[key].sort_values(key).values.tolist() == two[key].sort_values(key).values.tolist()
    assert (one.taken <= 3 * one["size"]).all() and len(one) == 931
    for _, g in one.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0] and abs(g.taken.sum() - g.target.iloc[0]) <= 30
    assert mixing.repeat(mixing.mix(d)).count() == one.copies.sum()
    # 300 equal rows are taken by their fraction, not together
    same = docs(spark, ["a b"] * 8, source=lambda i: "x").limit(1)
    many = same.crossJoin(spark.range(300)).drop("id").unionByName(docs(spark, ["c d"] * 300, source=lambda i: "y").filter("doc_id >= 0"))
    copies = mixing.mix(many, weights=(1, 3)).filter("row.source = 'x'").groupBy("copies").count().collect()
    assert {x.copies: x["count"] for x in copies} == {0: 150, 1: 150}
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_takes_documents_by_their_odds(spark):
    r = random.Random(19)
    rows = [(i, "s", r.randint(5, 15), r.choice([1.0, 2.0, 4.0, 8.0, 64.0, None])) for i in range(400)] + [(1000 + i, "t", 10, 1.0) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n long, w double").repartition(4).persist()
    size = sum(x[2] for x in rows if x[1] == "s")
    total, seeds = {}, 16
    for seed in range(seeds):
        got = mixing.mix(d, weights=(1, 2), seed=seed, odds=F.col("w"), size=F.col("n")).filter("row.source = 's'").select("doc_id", "copies", "taken", "target").collect()
        assert abs(sum(x.taken for x in got) - got[0].target) <= 8 and max(x.copies for x in got) <= 3
        for x in got:
            total.setdefault(x.doc_id, []).append(x.copies)
    target = got[0].target
    c = mixing._scale({k: sum(x[2] for x in rows if x[1] == "s" and round(16 * np.log2(x[3] or 2.0**-100)) == k) for k in (-1600, 0, 16, 32, 48, 96)}, target, 3)
    assert abs(sum(x[2] * min(3.0, c * (x[3] or 0)) for x in rows if x[1] == "s") - target) < 1e-3 * size
    for w in (1.0, 2.0, 4.0, 8.0, 64.0, None):
        ids = [x[0] for x in rows if x[1] == "s" and x[3] == w]
        mean = np.mean([np.mean(total[i]) for i in ids])
        want = min(3.0, c * (w or 0))
        assert abs(mean - want) < 0.09, (w, mean, want)
        assert all(np.floor(want + 1e-9) <= k <= np.ceil(want - 1e-9) for i in ids for k in total[i])


def test_top_k(spark):
    r = np.random.default_rng(10)
    x = r.normal(size=(300, 8)).astype("float32")
    x[50:90] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8)]
    v = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = knn.top_k(v, F.col("vec_id") % 50 == 0, k=5, pivots=8, per_slice=40, per_block=3).collect()
    q = np.floor(256 * x.astype("float64"))
    want = []
    for i in range(0, 300, 50):
        s = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    few = knn.top_k(v.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [x["rank"] for x in sorted(few)] == [1, 2]
    assert knn.top_k(v.limit(0), F.lit(True)).count() == 0
    assert knn.top_k(v, F.lit(None).cast("boolean")).count() == 0


def test_top_k_of_unequal_lengths_and_large_components(spark):
    r = random.Random(15)
    rows = [(i, [r.randint(-(1 << 31), 1 << 31) if i % 3 else r.randint(-9, 9) for _ in range(r.choice([0, 3, 5, 5, 5, 6]))]) for i in range(120)]
    rows += [(200, [1 << 62] * 3), (201, [1 << 62] * 4)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 10 == 0, pivots=6, probes=9, per_slice=16, per_block=3).collect()
    want = []
    for i, v in rows:
        if i % 10 == 0:
            score = lambda x: min(max(sum(a * b for a, b in zip(v, x)), -(1 << 63)), (1 << 63) - 1)  # noqa: B023, E731
            best = sorted((-score(x), j) for j, x in rows if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_replicates_little(spark):
    r = np.random.default_rng(16)
    middle = r.normal(size=(12, 16)) * 40
    x = middle[r.integers(0, 12, 3000)] + r.normal(size=(3000, 16))
    v = spark.createDataFrame([(i, [int(c) for c in np.floor(256 * y)]) for i, y in enumerate(x)], "vec_id long, v array<long>")
    queries, data = knn.deal(v, F.col("vec_id") % 50 == 0, per_block=20)
    # three blocks of queries; without bounds every vector would go to all of them, and every query to all of 64 cells
    sent, asked = data.count() / 3000, queries.count() / 60
    print(f"each vector is sent {sent:.2f} times, each query {asked:.2f} times")
    assert sent < 2 and asked < 20


def test_suffix_array():
    r = random.Random(11)
    for _ in range(300):
        x = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 60))] + [0]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_removed(rows):
    first, enc = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(enc):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, b in enc:
        g = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                g[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])), hashlib.sha256(bytes(c for c, x in zip(b, g, strict=True) if not x)).hexdigest()))
    return sorted(out)


def test_passages(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    shared = [" ".join(word() for _ in range(n)) for n in (6, 9, 12, 30, 80)]
    texts = [None, "", "short", "z" * 400, "z" * 120, "ab" * 90]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(3)]
        parts.insert(r.randrange(4), r.choice(shared))
        if r.random() < 0.3:
            x = r.choice(shared)
            parts.append(x[r.randrange(20) : len(x) - r.randrange(10)])
        texts.append(" ".join(parts))
    texts += [texts[10], texts[11][:-3] + "!!"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows += [rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removed(rows)
    assert sorted(map(tuple, passages.remove_repeats(d).collect())) == want
    assert passages.remove_repeats(d.limit(0)).count() == 0


def test_passages_twice_in_one_document(spark):
    r = random.Random(13)
    made = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for k in range(60):
        x, i = made(60), 10 * k
        # only both ends together cover x
        rows += [(i, x[:55] + made(9)), (i + 1, made(9) + x[5:]), (i + 2, f"{made(40)}{x}{made(40)}{x}{made(40)}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, passages.remove_repeats(d).collect())) == brute_removed(rows)


def test_passages_in_two_rows_of_one_doc_id(spark):
    r = random.Random(14)
    made = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for k in range(60):
        x, i = made(60), 10 * k
        rows += [(i, x[:55] + made(9)), (i + 1, made(9) + x[5:]), (i + 2, made(40) + x + made(40)), (i + 2, x + made(40))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, passages.remove_repeats(d).collect())) == brute_removed(rows)


def test_strip_keeps_columns(spark):
    p = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"
    got = {x.doc_id: x for x in passages.strip(docs(spark, [p, p, "own words " + p, None, "tiny"])).collect()}
    assert set(got) == {0, 2, 3, 4} and got[2].text.strip() == "own words" and got[0].text == p and got[3].kept == "k"
