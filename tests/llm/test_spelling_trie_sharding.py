"""Spelling variants, the conversation trie and shards against brute-force versions, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from findgrid.llm import sharding, spelling, trie

DOCS = "doc_id long, text string, word string, n string, shard0 string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "w", "n", "s") for i, t in enumerate(texts)], DOCS)


def brute_words(rows, least=5, damage=199):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (t or "").translate({65 + k: 97 + k for k in range(26)})):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    out = {}
    for w in n:
        all_ = [v for v in n if near(w, v)]
        best = min(all_, key=lambda v: (-n[v], v.encode()), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (form, n[w], len(all_), n[form] if form else None)
    res = set()
    for w, (form, c, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        res.add((w, form, root, c, k, m))
    return res


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_of_small_documents(spark):
    r = random.Random(1)
    base = ["quebec" + "".join(r.choice("abé") for _ in range(r.randint(0, 5))) for _ in range(60)] + ["ÉÀÜÿÿÿ", "straße"]
    texts = [" ".join(r.choice(base[:10] * 9 + base) + r.choice([",", "", "-X", "9"]) for _ in range(80)) for _ in range(60)]
    texts += [None, "", " \n", "Quebeca" * 3, "日本語 123", *["same words quebeca quebecb"] * 9, "Quebeca quebecé " * 30_000]
    ids = [*range(len(texts) - 2), None, 3]  # a missing doc_id, and one that is repeated
    want = brute_variants(brute_words(zip(ids, texts, strict=True), damage=17))
    got = spelling.variants(spelling.words(docs(spark, texts, ids), damage=17))
    assert rows_of(got) == want and any(f for _, f, *_ in want) and len(want) > 30
    assert spelling.variants(spelling.words(docs(spark, []))).count() == 0


@pytest.mark.parametrize("crowded", [1, 3, 200])
def test_near_words_of_crowded_halves(spark, crowded):
    r = random.Random(2)
    vocab = {"aaaaaaaaaa" + "".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(40)} | {"".join(r.choice("ab") for _ in range(r.randint(6, 8))) for _ in range(80)} | {"abcdef", "abcdefg", "éabcde", "b" * 30, "b" * 31}
    v = spark.createDataFrame([(w, 5) for w in vocab], "word string, n long")
    got = sorted((x.word, x.other) for x in spelling.near(v, crowded).collect())
    assert got == sorted((a, b) for a in vocab for b in vocab if near(a, b))


def test_roots_follow_forms(spark):
    v = spark.createDataFrame([("lettera", 1), ("letterb", 5), ("letterbb", 25), ("letterbbc", 125), ("letterc", 25), ("letterd", 25)], "word string, n long")
    got = {x.word: (x.form, x.root) for x in spelling.variants(v).collect()}
    assert got["lettera"] == ("letterc", "letterc") and got["letterb"] == ("letterbb", "letterbbc") and got["letterbb"] == ("letterbbc", "letterbbc") and got["letterd"] == (None, "letterd")


def brute_trie(rows, every=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + t[h:]
    node = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            node[tuple(t[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in node:
        if p:
            kids[p[:-1]] += 1
    for p, m in node.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()
    return {(min(m), len(p), min(node[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in node.items()}


CONV = "conv_id long, turn long, role string, text string, key string, depth string, node string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", "n") for r in rows], CONV)


def test_trie_of_small_conversations(spark):
    r = random.Random(4)
    say = ["hi there", "how are you", "", None, "fine  thanks\n a lot", "x " * 2000]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(say)) for c in [*range(-3, 130, 1)] for t in range(r.randint(1, 5))]
    rows += [(200 + k, t, "user", f"same {t}") for k in range(20) for t in range(6)]  # copies, of which none is like another after its head
    rows += [(401 + k, t, "user", f"long {t}") for k in range(3) for t in range(40)]  # deep
    rows += [(None, 1, "user", "lost"), (500, None, "user", "b"), (500, None, "user", "a"), (500, 0, "user", "c"), (500, 0, "user", "c"), (500, 0, None, None), (513, 0, "user", "only")]
    got = {tuple(x) for x in trie.prefix_trie(*trie.rebuilt(*trie.ordered(conversations(spark, rows).repartition(7)))).collect()}
    want = brute_trie(rows)
    assert got == want and max(x[1] for x in want) > 30


def test_trie_of_many_copies_and_of_none(spark):
    rows = [(c * 20, t, "user", f"turn {t}") for c in range(9000) for t in range(2)]
    plain = lambda rows: {tuple(x) for x in trie.prefix_trie(*trie.ordered(conversations(spark, rows))).collect()}
    digest = hashlib.sha256(",".join(str(c * 20) for c in range(9000)).encode()).hexdigest()  # ids of many blocks
    assert plain(rows) == {(0, 0, None, 9000, 1, 1, 8999 * 4, trie.EMPTY), (0, 1, 0, 9000, 1, 1, 8999 * 4, trie.EMPTY), (0, 2, 0, 9000, 0, 1, 8999 * 2, digest)}
    assert plain([]) == set() and plain([(None, 0, "user", "x")]) == set()
    assert plain([(7, 0, None, None)]) == {(7, 0, None, 1, 1, 1, 0, trie.EMPTY), (7, 1, 7, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())}


def check_shards(got, texts, n=8, tolerance=0.1):
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    total, size, slots = sum(r.size for r in got), Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max((r.size for r in got), default=0)
    assert all(abs(size[k] - total / n) <= largest + tolerance * total / n for k in range(n)) or largest > total / n
    return size


def test_shards_are_near_equal(spark):
    r = random.Random(5)
    texts = ["é" * r.randint(0, 60) + str(i) for i in range(3000)]
    size = check_shards(sharding.shards(docs(spark, texts)).collect(), texts)
    assert max(size.values()) / min(size.values()) < 1.02


@pytest.mark.parametrize("texts", [
    ["one text that most rows share " * 3] * 900 + [f"t{i}" for i in range(600)],
    [None] * 500 + [""] * 500 + ["x"] * 3, [None], [], ["a"] * 5, ["z" * 500_000] + ["y" * 40] * 2000, [f"w{i}" for i in range(30)],
], ids=["copies", "empty", "one", "none", "few", "long", "words"])
def test_shards_of_odd_tables(spark, texts):
    ids = [None if i % 50 == 7 else i // 3 for i in range(len(texts))]  # missing and repeated doc_ids
    check_shards(sharding.shards(docs(spark, texts, ids)).collect(), texts, tolerance=0.02)


def test_copies_share_a_shard_and_reruns_agree(spark):
    texts = [f"text number {i // 2} of many " * 4 for i in range(4000)]
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs(spark, texts)).collect()}
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs(spark, texts).repartition(5)).collect()}
    assert one == again and sum(one[2 * i][0] != one[2 * i + 1][0] for i in range(2000)) <= 7


def test_sharded_rows_and_files(spark, tmp_path):
    texts = [f"text {i} " * (i % 9) for i in range(400)] + [None]
    d = docs(spark, texts)
    got = sharding.sharded(d, 3)
    assert got.columns == [*d.columns, "shard", "slot"] and sorted((r.text or "") for r in got.collect()) == sorted(t or "" for t in texts)
    sharding.write(d, f"{tmp_path}/out", 3, split_rows=50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in got.collect()}
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 50
    with pytest.raises(ValueError):
        sharding.sharded(d.withColumn("Slot", F.lit(1)))
