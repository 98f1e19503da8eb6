import itertools
import random
import re

from findgrid.llm import minhash


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, n)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for base in range(3):
        text = [r.choice(vocab) for _ in range(150)]
        rows.append(list(text))
        for _ in range(70):
            t = list(r.choice(rows[-8:]) if r.random() < 0.4 else text)
            for _ in range(r.randint(1, 9)):
                k = r.randrange(len(t))
                if r.random() < 0.3:
                    del t[k]
                else:
                    t[k] = r.choice(vocab)
            rows.append(t)
    texts = [" ".join(t) for t in rows] + ["", None, "one two", "One  TWO", " \n ", "three"]
    r.shuffle(texts)
    return list(enumerate(texts, 5))


def test_components_match_brute_force_in_large_and_small_groups(spark):
    for seed, small in ((1, 2), (2, 1000), (3, 12)):
        rows = corpus(seed)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, small=small).collect()
        want = brute(rows, 4)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_takes_one_row_of_each_group_and_handles_repeats_and_clashing_columns(spark):
    rows = [(3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (9, "A b c  d e f", "y"), (4, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.keep(docs).collect()) == [(3, "x"), (4, "z")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs, 4).count() == 0
