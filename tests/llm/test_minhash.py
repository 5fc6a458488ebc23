import itertools
import random

from newsloom.llm import minhash
from newsloom.llm.components import connected_components

SETTINGS = minhash.Settings(width=3, percent=85)
SCHEMA = "doc_id long, text string, digest string, node int"


def brute(rows, width, percent):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        k = min(width, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def near_copies(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, at = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((at, " ".join(copy)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n "), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two"), (at + 6, "One  two\n"), (at + 7, "x " * 50_000)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, settings=SETTINGS).collect()}
    assert got == brute(rows, 3, 85)


def test_chain_of_near_copies_is_one_component(spark):
    """Each link of the chain is over the threshold, its ends are not; ids are out of order."""
    words = [f"a{i}" for i in range(200)]
    rows = []
    for step in range(12):
        words = list(words)
        for k in range(3):
            words[(step * 17 + k) % 200] = f"b{step}_{k}"
        rows.append(((step * 7) % 12, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, settings=SETTINGS).collect()}
    assert got == {d: c for d, (_, c, _) in brute(rows, 3, 85).items()}


def test_empty_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert sorted(r.doc_id or -1 for r in minhash.drop_near_duplicates(docs).collect()) == [-1, 3]


def test_components_of_a_path_and_loops(spark):
    edges = [(i + 1, i) for i in range(40)] + [(7, 7), (100, 101), (101, 100), (None, 3)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
