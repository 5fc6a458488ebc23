import numpy as np
import pytest
from newsloom.llm import embedding_dedup as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    good = [(i, np.asarray(v, np.float64)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (links[i], find(i), find(i) == i) for i in root}


def rows_of(seed=2, n=400, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        x = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            rows.append((x + rng.normal(size=dim) * 0.1).astype(np.float32).tolist())
    hub = rng.normal(size=dim)
    rows += [(hub + rng.normal(size=dim) * 0.05).astype(np.float32).tolist() for _ in range(150)]
    rows += [rows[0]] * 30 + [(3 * np.asarray(rows[1])).tolist(), None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), rows[2][:8], rows[2][:8]]
    order = rng.permutation(len(rows))
    return [(int(order[i]), v) for i, v in enumerate(rows)]


def test_matches_brute_force(spark):
    rows = rows_of()
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn.near_duplicates(table, settings=nn.Settings(block=64, leaf=60)).collect()}
    assert got == brute(rows)


def test_lists_grow_where_saturated_and_the_audit_sees_misses(spark):
    rng = np.random.default_rng(0)
    hub = rng.normal(size=8)
    x = np.stack([hub + rng.normal(size=8) * 0.01 for _ in range(40)] + [rng.normal(size=8) for _ in range(60)])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    vectors = nn._nodes(table)
    s = nn.Settings(neighbours=4, longest=16)
    lists, recall = nn.neighbour_graph(vectors, 8, s)
    sizes = {r.node: r["count"] for r in lists.groupBy("node").count().collect()}
    assert all(4 < sizes[i] <= 16 for i in range(40)) and max(sizes.values()) > 8 and recall > 0.9
    assert nn._audit(vectors, lists.limit(0), s) == 0.0


def test_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nn.near_duplicates(empty).collect() == []
    table = spark.createDataFrame([(7, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (3, None, 0)], SCHEMA)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in nn.near_duplicates(table).collect())
    assert got == [(-1, 1, 7, False), (3, 0, 3, True), (7, 0, 7, True), (7, 1, 7, True)]


def test_tight_groups_that_link_with_each_other_are_one_component(spark):
    rng = np.random.default_rng(4)
    dim, n = 24, 120
    a = np.eye(dim)[0]
    b = np.cos(0.25) * a + np.sin(0.25) * np.eye(dim)[1]  # cosine 0.969 between the centres
    far = np.eye(dim)[5]
    x = np.concatenate([c + rng.normal(size=(n, dim)) * 0.006 for c in (a, b, far)] + [rng.normal(size=(200, dim))])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for s in (nn.Settings(), nn.Settings(block=50, cells=2, radius=0.03)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn.near_duplicates(table, settings=s).collect()}
        assert got == brute(rows)
    assert {got[i][1] for i in range(2 * n)} == {0} and got[2 * n][1] == 2 * n


def test_the_last_audit_takes_all_links(spark):
    rng = np.random.default_rng(6)
    x = np.eye(8)[0] + rng.normal(size=(90, 8)) * 0.005
    vectors = nn._nodes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>"))
    parts = spark.createDataFrame([(i, i // 45) for i in range(90)], "node long, part long")
    assert nn._audit_parts(vectors, parts, nn.Settings()) == 2 * 45 * 44 / (90 * 89)


def test_missed_links_are_repaired_with_further_graphs(spark, monkeypatch):
    rows = rows_of()
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    seen, graph = [], nn.neighbour_graph

    def poor_first(vectors, dim, s):
        lists, recall = graph(vectors, dim, s)
        if dim == 16:
            seen.append(s.seed)
        return (nn.stored(lists.filter("cos < 0.5")) if len(seen) == 1 else lists), recall

    monkeypatch.setattr(nn, "neighbour_graph", poor_first)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn.near_duplicates(table, settings=nn.Settings(block=64, leaf=60)).collect()}
    assert len(seen) == len(set(seen)) > 1 and got == brute(rows)
    monkeypatch.setattr(nn, "_audit_parts", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="0.5000 of the audited"):
        nn.near_duplicates(table, settings=nn.Settings(repairs=1))
