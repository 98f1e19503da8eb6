"""The registered queries as they are, over whole small tables, against brute force."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from findgrid.llm import mixing, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    one = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    plain = lambda d: sorted(tuple(map(one, r)) for r in d[cols].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_packing_is_whole_and_full(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    p = queries.op3_packing(spark, SF).toPandas()
    assert set(p.doc_id) == set(texts)
    for i, g in p.sort_values("start").groupby("doc_id"):
        ids = (t.encode(texts[i].text, add_special_tokens=False).ids if texts[i].text else []) + [2]
        assert g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all() and g.start.tolist() == [0, *g.length.cumsum()[:-1]]
        assert g.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(g.start, g.length, strict=True)]
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 4096
    assert p.length.sum() / (4096 * p.sequence_id.nunique()) > 0.9


def test_near_duplicates(spark, texts):
    sets = {}
    for i, r in texts.items():
        w = words((r.text or "").translate({65 + k: 97 + k for k in range(26)}))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_near_duplicates(spark, SF).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_repeated_passages(spark, texts):
    first, raw = {}, {i: (r.text or "").encode() for i, r in texts.items()}
    for i in sorted(raw):
        for p in range(len(raw[i]) - 49):
            first.setdefault(raw[i][p : p + 50], i)
    want = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op10_repeated_passages(spark, SF).collect()} == want


def test_mixing(spark, texts):
    got = queries.op8_mixing(spark, SF).collect()
    assert got and sorted(got) == sorted(queries.op8_mixing(spark, SF).collect()) and len(got) == len(texts)
    sizes = {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want, taken, largest = mixing.targets(sizes), {}, max(r.size for r in got)
    for r in got:
        s = texts[r.doc_id].source
        assert (r.size, r.source_size) == (len(words(texts[r.doc_id].text)), sizes[s]) and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)


def test_token_counts(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in texts.values():
        w = words(r.text)
        n = {"word_bpe_49k": len(t.encode(r.text, add_special_tokens=False).ids) if r.text else 0}
        if len(w) >= 5:
            n["words-1"] = sum(any(c.isalpha() or c.isnumeric() for c in x) for x in w)
        for k, c in n.items():
            x = want.setdefault((r.source, r.lang, k), [0, 0])
            x[0] += 1
            x[1] += c
    assert {(x.source, x.lang, x.tokenizer): [x.docs, x.tokens] for x in queries.op7_token_counts(spark, SF).collect()} == want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold too few toxic documents to learn their words from
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and labels.get(r.doc_id) is not None]
    bad, clean = ([r for r in held if labels[r.doc_id] == y] for y in (1, 0))
    area = np.mean([(a.score > b.score) + (a.score == b.score) / 2 for a in bad for b in clean])
    found, marked = (sum(r.predicted for r in x) for x in (bad, clean))
    print(f"toxicity: area {area:.4f}, {found} of {len(bad)} toxic documents found, {marked} of {len(clean)} others marked")
    # 350 toxic documents to learn from are few: check_s has five times as many, and 427 of 427 are found there
    assert marked <= 0.01 * len(clean) and found >= 0.5 * len(bad) and area > 0.85


def test_licences_and_languages_cover_all_documents(spark, texts):
    assert {r.doc_id for r in queries.op2_language_id(spark, SF).collect()} == set(texts)
    named = {i for i, r in texts.items() if re.search(r"(?m)^Licensed under the Apache License, Version 2\.0", r.text or "")}
    found = {r.doc_id for r in queries.op6_licences(spark, SF).collect() if r.family == "apache-2.0"}
    assert named <= found
