"""The pipeline on a small table, each stage against a brute-force version of what it must do."""

import itertools
import random
import re

import corpus_pipeline
from findgrid.llm import quality


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({65 + i: 97 + i for i in range(26)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def removed(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b = t.encode()
        g = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                g[p : p + 50] = b"\1" * 50
        out[i] = bytes(c for c, x in zip(b, g, strict=True) if not x).decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    r = random.Random(1)
    vocab = ["the", "of", "and", *("w" + "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(900))]
    text = lambda n: " ".join(r.choice(vocab[:3]) if r.random() < 0.3 else r.choice(vocab) for _ in range(n))
    common = text(40)
    texts = []
    for i in range(60):
        t = text(r.randint(30, 120)) + ("\n" + common if i % 4 == 0 else "") + "\n" + text(20)
        texts.append(t)
        if i % 10 == 0:
            texts += [t, t.replace(" the ", " of ", 1)]
    texts += ["###$$$ %%% " * 30, "short text", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, str(tmp_path))
    verdicts = {x.doc_id for x in quality.quality_rules(docs).collect() if x.kept}
    assert kept.columns == columns and {x.doc_id for x in kept.collect()} == verdicts and len(verdicts) >= 60

    one = stages["near copies"](spark, kept, str(tmp_path))
    rest = {x.doc_id: x.text for x in kept.collect()}
    sets = {i: shingles(t) for i, t in rest.items()}
    parent = {i: i for i in rest}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(rest), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert one.columns == columns and sorted(x.doc_id for x in one.collect()) == sorted({find(i) for i in rest})

    cut = stages["repeated passages"](spark, one, str(tmp_path))
    left = {i: t for i, t in removed([(x.doc_id, x.text) for x in one.collect()]).items() if t.strip()}
    assert cut.columns == columns and {x.doc_id: x.text for x in cut.collect()} == left

    mixed = stages["mixing"](spark, cut, str(tmp_path))
    assert mixed.columns == columns and {x.doc_id for x in mixed.collect()} <= set(left)

    packed = stages["packing"](spark, mixed, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    copies = {}
    for x in mixed.collect():
        copies[x.doc_id] = copies.get(x.doc_id, 0) + 1
    for i, g in packed.groupby("doc_id"):
        assert g.length.sum() == copies[i] * g.doc_tokens.iloc[0]
    assert set(packed.doc_id) == set(copies)
