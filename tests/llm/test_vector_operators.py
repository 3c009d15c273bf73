import numpy as np
import pytest

from quarrylog.llm import neighbours, topk
from quarrylog.llm import components as components_module
from quarrylog.llm.components import components

ODD = [
    (3, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, [2.0, 4.1], "x"), (None, [1.0, 2.0], "x"), (9, None, "x"), (4, [float("nan"), 1.0], "x"),
    (5, [None, 1.0], "x"), (6, [], "x"), (7, [0.0, 0.0], "q"), (8, [-1e300, 1e300], "q"), (50, [3.0], None),
]
SCHEMA = "vec_id long, embedding array<double>, node string"


def planted(n, groups, seed):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, 32))
    at = 0
    for size in groups:
        m[at : at + size] = m[at] + 0.15 * rng.standard_normal((size, 32))
        at += size
    return m[rng.permutation(n)]


def test_near_duplicates(spark):
    m = planted(1500, [2] * 40 + [5] * 10 + [60, 200], 1)
    m[7] = m[3]
    found = {r["vec_id"]: r for r in neighbours.near_duplicates(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(r["n_links"] for r in found.values()) >= 0.97 * near.sum() and all(r["n_links"] <= near[k].sum() for k, r in found.items())
    least = np.arange(len(m))
    while (now := np.minimum(least, np.where(near, least[None, :], len(m)).min(1))).tolist() != least.tolist():
        least = now
    assert np.mean([found[k]["component_id"] == least[k] for k in range(len(m))]) > 0.97
    assert all(r["kept"] == (k == r["component_id"]) for k, r in found.items())


def test_near_duplicates_across_tight_groups(spark):
    """Groups tighter than any list is long, with links between them that no list can hold; the last one is far off."""
    rng = np.random.default_rng(5)
    at = np.eye(32)[:5]
    turned = [at[0], 0.95 * at[0] + np.sqrt(1 - 0.95**2) * at[1], 0.95 * at[0] - np.sqrt(1 - 0.95**2) * at[1], at[3]]
    m = np.concatenate([c + 0.01 * rng.standard_normal((170, 32)) for c in turned] + [rng.standard_normal((300, 32))])
    m = m[rng.permutation(len(m))]
    found = {r["vec_id"]: r for r in neighbours.near_duplicates(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert sorted(set(near.sum(1)))[-2:] == [339, 509]
    least = np.arange(len(m))
    while (now := np.minimum(least, np.where(near, least[None, :], len(m)).min(1))).tolist() != least.tolist():
        least = now
    assert [(found[k]["n_links"], found[k]["component_id"]) for k in range(len(m))] == list(zip(near.sum(1).tolist(), least.tolist(), strict=True))


def test_members_of_a_hub_meet_in_later_rounds(spark):
    """Node 0 is in 400 lists, whose owners are a group; pairs dealt to different groups in one round are compared in another."""
    m = planted(400, [400], 8)
    nodes = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "node long, embedding array<double>").cache()
    graph = spark.createDataFrame([(k, 0, 0.5, False) for k in range(1, 400)], neighbours._GRAPH)
    met = [{(r["u"], r["v"]) for r in neighbours.better(graph, nodes, 400, 4, turn).where("new").collect()} for turn in range(2)]
    assert met[0] and len(met[1] - met[0]) > 0.5 * len(met[1])


def test_audit_sees_small_groups_beside_a_hot_one(spark):
    m = planted(900, [300] + [2] * 100, 7)
    near = (u := m / np.linalg.norm(m, axis=1, keepdims=True)) @ u.T >= 0.9
    linked = near.sum(1) - 1
    nodes = spark.createDataFrame([(k, 1, x.tolist()) for k, x in enumerate(m)], "node long, copies long, embedding array<double>")
    # all links of the hot group, none of the pairs
    degrees = spark.createDataFrame([(k, int(n), True) for k, n in enumerate(linked) if n > 1], "node long, linked long, exact boolean")
    assert linked[linked > 1].sum() > 0.98 * linked.sum() and (linked == 1).sum() > 100
    assert neighbours.audit(nodes, degrees, 0.9) < 0.5


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = {r["vec_id"]: tuple(r)[1:] for r in neighbours.near_duplicates(df).collect()}
    assert rows == {**{k: (0, k, True) for k in (4, 5, 6, 7, 8, 9, 50)}, 1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), None: (3, 1, False)}
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def brute_top(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q is not None and q % 50 == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i is None, i or 0) for i, b in good if i != q]  # noqa: B905
            out += [(q, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("sizes", [(64, 3, 2), (4096, 512, 32)])
def test_top_k(spark, monkeypatch, sizes):
    for name, n in zip(("SHARD", "TILE", "FAN"), sizes, strict=True):
        monkeypatch.setattr(topk, name, n)
    m = np.round(np.random.default_rng(2).standard_normal((400, 8)), 1)  # many ties
    rows = [(k, x.tolist()) for k, x in enumerate(m)] + [(450, m[0].tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect()) == sorted(brute_top(rows))


def test_top_k_of_odd_rows(spark):
    rows = [*ODD, (100, [1e18, -3.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect()), key=key) == sorted(brute_top([r[:2] for r in rows]), key=key)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, x) for x in range(501, 560)] + [tuple(map(int, rng.integers(1000, 1080, 2))) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


def test_topk_with_an_outlier_among_ordinary_rows(spark, monkeypatch):
    """Products beyond 2**53 are exact, and only rows that need it are scored apart; shards, slots and tiles are many."""
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "HELD", 1024)
    rng = np.random.default_rng(2)
    m = np.round(rng.standard_normal((150, 3)), 3)
    m[17] = [3e13, -1e13 - 0.25, 7.0]
    m[60] = [2e12, 5e12, 0.125]
    m[61:90] = m[30]  # ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = [[int(x) for x in np.floor(256.0 * v)] for v in m]
    want = []
    for q in range(0, 150, 7):
        scored = sorted((-sum(x * y for x, y in zip(whole[q], whole[c], strict=True)), c) for c in range(150) if c != q)[:5]
        want += [(q, n + 1, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, c) in enumerate(scored)]
    got = topk.search(df, df.where("vec_id % 7 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_neighbours_of_any_length(spark):
    """Vectors of over 4096 components, of unequal lengths, and of equal direction but unequal values."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((6, 5000))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(10 + k, [float(2 * x) for x in v]) for k, v in enumerate(base[:3])]
    rows += [(20, [1.0]), (21, [3.0, 0.0]), (22, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(df).collect()}
    want = {k: (1, k, True) for k in range(3)} | {k: (0, k, True) for k in range(3, 6)} | {10 + k: (1, k, False) for k in range(3)}
    assert found == want | {20: (1, 20, True), 21: (1, 20, False), 22: (0, 22, True)}


@pytest.mark.parametrize("hot", [2, 512])
def test_components_of_hubs(spark, monkeypatch, hot):
    """Stars, chains and hubs in the middle of the order, with repeated, reversed, null and own links."""
    monkeypatch.setattr(components_module, "HOT", hot)
    rng = np.random.default_rng(5)
    pairs = [(500, k) for k in range(0, 60)] + [(k, k + 1) for k in range(100, 140)] + [(900, 901), (901, 900), (7, 7), (900, 900)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(200, 400, (90, 2))]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = spark.createDataFrame([*pairs, *pairs[:20], (None, 3), (4, None)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
