"""Embedding near-duplicates by NN-descent.

1. Equal vectors are one node (with its number of copies), so a common vector costs one row.
2. First lists: nodes are sorted by random-hyperplane signatures, several times, and each run of BLOCK neighbours in that order is
   compared within itself.
3. NN-descent: each node's neighbours (both directions) are compared with one another where one of them is new; better
   ones enter the lists, until few entries change. Neighbourhoods of over MEMBERS nodes are dealt to several groups.
4. Entries with cosine >= threshold are links; their components are found on the cluster.
5. A list whose entries all are links is saturated: it can miss links to nodes of its own component and, where its neighbours are a
   tight group, of other ones. The other end of such a link has it in its list unless that is saturated, too. So the components of
   saturated lists are cut into tiles of TILE nodes, and all pairs of tiles, of one component or of two, are compared that can hold
   links by the angles of nodes to centers of tiles. They return counts and pairs of components, not pairs of nodes. Nothing is capped.
6. Audit: AUDIT nodes are compared with all others. Below RECALL, lists are doubled and the descent goes on; it fails if lists of all
   nodes are still below.

Cosines are of unit vectors in double precision. Vectors that are null, zero, or hold null or non-finite components link with nothing;
shorter ones count as filled up with zeros. Null vec_ids are never a smallest id. Repeated rows link with one another. Empty tables
give empty results; columns other than vec_id and embedding are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import partitions, session, written
from quarrylog.llm.components import components
from quarrylog.llm.vectors import finite, matrix

THRESHOLD = 0.9
K = 16
TABLES = 8
BLOCK = 512
MEMBERS = 128
TILE = 1024
#: Centers of tiles sent to the executors at once.
CENTERS = 16_384
AUDIT = 1024
RECALL = 0.98
ROUNDS = 10
#: A round that changes fewer entries than this share ends the descent.
STILL = 0.002
SEED = 20
_GRAPH = "u long, v long, s double, new boolean"


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(axis=1, initial=0, keepdims=True), np.finfo(float).tiny)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)


def _whole(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first `keys` columns."""
    have: list[pa.RecordBatch] = []
    n = 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if not b.num_rows:
                continue
            have.append(b)
            n += b.num_rows
            if n < rows:
                continue
        if not have:
            return
        t = pa.Table.from_batches(have).combine_chunks()
        if b is None:
            yield t
            return
        starts = _starts(t, keys)
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1]))
            t = t.slice(int(starts[-1]))
        have, n = t.to_batches(), 0 if len(starts) > 1 else n


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    cols = [t.column(k).to_numpy() for k in range(keys)]
    return np.concatenate(([0], np.nonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))[0] + 1))


def _out(u, v, s, new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64()), pa.array(new, pa.bool_())], ["u", "v", "s", "new"])


# --- the graph ------------------------------------------------------------------------------------------------------------


def _signed(nodes: DataFrame, tables: int, seed: int) -> DataFrame:
    """A row for each node and table with the signature, whose bits are the sides of 62 hyperplanes, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = unit(matrix(b.column(1)))
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).standard_normal((m.shape[1], 62))  # longer vectors draw the same ones first
                sig = ((m @ planes > 0) @ (1 << np.arange(61, -1, -1, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(sig), b.column(0), b.column(1)], ["t", "sig", "node", "embedding"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "embedding").mapInArrow(run, f"t int, sig long, node long, embedding {kind}")


def first_lists(nodes: DataFrame, k: int, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 1, BLOCK):
            table, node, m = t.column(0).to_numpy(), t.column(2).to_numpy(), unit(matrix(t.column(3)))
            # runs of about BLOCK rows of one table
            cut = [0, *(np.nonzero(np.diff(table))[0] + 1).tolist(), len(node)]
            for a, b in itertools.pairwise(cut):
                for part in np.array_split(np.arange(a, b), max(1, -(-(b - a) // BLOCK))):
                    if len(part) < 2:
                        continue
                    s = m[part] @ m[part].T
                    np.fill_diagonal(s, -2)
                    most = min(k, len(part) - 1)
                    best = np.argpartition(-s, most - 1, axis=1)[:, :most]
                    u = np.repeat(np.arange(len(part)), most)
                    v = best.reshape(-1)
                    yield _out(node[part[u]], node[part[v]], s[u, v], np.ones(len(u), bool))

    rows = _signed(nodes, tables, seed)
    parts = partitions(nodes, per=2 << 20)
    return _merged(rows.repartitionByRange(parts, "t", "sig").sortWithinPartitions("t", "sig").mapInArrow(run, _GRAPH), k, parts)


def _merged(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best entries of each node; an entry that was there before isn't new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 1):
            u, v, s, new = (t.column(c).to_numpy() for c in range(4))
            order = np.lexsort((new, v, u))
            u, v, s, new = u[order], v[order], s[order], new[order]
            keep = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
            u, v, s, new = u[keep], v[keep], s[keep], new[keep]
            order = np.lexsort((v, -s, u))
            u, v, s, new = u[order], v[order], s[order], new[order]
            start = np.concatenate(([0], np.nonzero(np.diff(u))[0] + 1))
            rank = np.arange(len(u)) - np.repeat(start, np.diff(np.concatenate((start, [len(u)]))))
            keep = rank < k
            yield _out(u[keep], v[keep], s[keep], new[keep])

    return rows.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(run, _GRAPH)


def better(graph: DataFrame, nodes: DataFrame, k: int, parts: int, turn: int = 0) -> DataFrame:
    """One round of NN-descent: the lists after each neighbourhood's members were compared with one another. Members of large ones are dealt
    anew each turn and all count as new, as those of other groups weren't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 2):
            member, new, floor = (t.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            m = unit(matrix(t.column(5)))
            starts = [*_starts(t, 2).tolist(), t.num_rows]
            found = []
            for a, b in itertools.pairwise(starts):
                if b - a < 2 or not new[a:b].any():
                    continue
                s = m[a:b] @ m[a:b].T
                good = (s > floor[a:b, None]) & (new[a:b, None] | new[None, a:b]) & (member[a:b, None] != member[None, a:b])
                i, j = np.nonzero(good)
                found.append((member[a + i], member[a + j], s[i, j]))
            if found:
                u, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _out(u, v, s, np.ones(len(u), bool))

    least = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(-2.0).alias("floor"))
    info = nodes.select("node", "embedding").join(least, F.col("node") == F.col("u"), "left").select("node", F.coalesce("floor", F.lit(-2.0)).alias("floor"), "embedding")
    ways = graph.select(F.col("u").alias("center"), F.col("v").alias("member"), "new").union(graph.select(F.col("v").alias("center"), F.col("u").alias("member"), "new"))
    ways = ways.groupBy("center", "member").agg(F.max("new").alias("new"))
    busy = written(ways.groupBy("center").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS).select(F.col("center").alias("busy"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("groups")), "busy")
    ways = ways.join(busy, F.col("center") == F.col("busy"), "left")
    ways = ways.withColumn("group", F.when(F.col("busy").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(turn), "center", "member"), F.col("groups"))).cast("int"))
    ways = ways.withColumn("new", F.col("new") | F.col("busy").isNotNull())
    dealt = ways.join(info, F.col("member") == F.col("node")).select("center", "group", "member", "new", "floor", "embedding")
    found = dealt.repartition(parts, "center", "group").sortWithinPartitions("center", "group").mapInArrow(run, _GRAPH)
    return _merged(graph.withColumn("new", F.lit(False)).union(found), k, parts)


# --- links ------------------------------------------------------------------------------------------------------------------


def _tiles(members: DataFrame, parts: int) -> DataFrame:
    """members: root, node, embedding. Gives root, mine, tile, center, radius (an angle) of each tile of about TILE nodes of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 2, 2 * TILE):
            root, mine, m = t.column(0).to_numpy(), t.column(1).to_numpy(), unit(matrix(t.column(2)))
            at = _starts(t, 2)
            center = unit(np.add.reduceat(m, at))
            cosine = np.einsum("ij,ij->i", m, np.repeat(center, np.diff([*at, len(m)]), axis=0))
            radius = np.arccos(np.clip(np.minimum.reduceat(cosine, at), -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(root[at]), pa.array(mine[at]), pa.array(center.tolist(), pa.list_(pa.float64())), pa.array(radius)], ["root", "mine", "center", "radius"])

    rows = members.select("root", "mine", "embedding").repartition(parts, "root", "mine").sortWithinPartitions("root", "mine")
    made = rows.mapInArrow(run, "root long, mine int, center array<double>, radius double")
    return written(made.withColumn("tile", F.monotonically_increasing_id()), "tiles")


def _reach(members: DataFrame, tiles: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b), a <= b: the pairs of tiles that can hold links. A node within the threshold of a member of a tile is within the threshold's
    angle plus the tile's radius of its center; a pair stays if both tiles have such nodes. Centers are broadcast CENTERS at a time."""
    members, found = members.select("tile", "embedding"), None
    blocks = -(-tiles.count() // CENTERS)
    for block in range(blocks):
        some = tiles.where(F.pmod(F.xxhash64("tile"), F.lit(blocks)) == block).select("tile", "center", "radius").toArrow()
        if not some.num_rows:
            continue
        ids, c = some.column(0).to_numpy(), matrix(some.column(1))
        # the slack covers rounding
        least = np.cos(np.minimum(np.arccos(threshold) + some.column(2).to_numpy() + 1e-6, np.pi)) - 1e-9

        def run(batches: Iterator[pa.RecordBatch], ids=ids, c=c, least=least) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, TILE):
                    part = b.slice(lo, TILE)
                    m = unit(matrix(part.column(1), c.shape[1]))[:, : c.shape[1]]
                    i, j = np.nonzero(m @ c.T >= least)
                    x = np.unique(np.stack([part.column(0).to_numpy()[i], ids[j]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["x", "y"])

        more = written(members.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(run, "x long, y long"), "reach")
        found = more if found is None else found.union(more)
    if found is None:
        found = tiles.select(F.col("tile").alias("x"), F.col("tile").alias("y"))
    sides = found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return written(sides.where("low < high or a = b").select("a", "b"), "pairs")


def _tiled(members: DataFrame, threshold: float, parts: int) -> tuple[DataFrame, DataFrame]:
    """members: root, node, copies, embedding. For each node the copies of members it links with, whatever their component; and the
    pairs (a, b) of components with links between them. All pairs of tiles are compared that can hold links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 2, 2 * TILE):
            a, b, tile, root, node, copies = (t.column(c).to_numpy() for c in range(6))
            m = unit(matrix(t.column(6)))
            for lo, hi in itertools.pairwise([*_starts(t, 2).tolist(), t.num_rows]):
                at = np.arange(lo, hi)
                x, y = at[tile[lo:hi] == a[lo]], at[tile[lo:hi] == b[lo]]
                near = m[x] @ m[y].T >= threshold
                if a[lo] == b[lo]:
                    np.fill_diagonal(near, False)
                    yield _counted(node[x], near @ copies[y])
                elif near.any():
                    yield _counted(node[x], near @ copies[y])
                    yield _counted(node[y], near.T @ copies[x])
                    if root[x[0]] != root[y[0]]:
                        yield _counted([None], [None], [root[x[0]]], [root[y[0]]])

    size = members.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = written(members.join(size, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("tiles"), "members")
    tiles = _tiles(rows, parts)
    rows = rows.join(tiles.select("root", "mine", "tile"), ["root", "mine"])
    pairs = _reach(rows, tiles, threshold, parts)
    sides = pairs.select("a", "b", F.col("a").alias("tile")).union(pairs.where("a <> b").select("a", "b", F.col("b").alias("tile")))
    dealt = sides.join(rows, "tile").select("a", "b", "tile", "root", "node", "copies", "embedding").repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    found = written(dealt.mapInArrow(run, "node long, linked long, a long, b long"), "tiled")
    return found.where("a is null").groupBy("node").agg(F.sum("linked").alias("linked")), found.where("a is not null").select("a", "b").distinct()


def _counted(node, linked, a=None, b=None) -> pa.RecordBatch:
    none = [None] * len(node)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, linked, none if a is None else a, none if b is None else b)], ["node", "linked", "a", "b"])


def _degrees(node: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(linked.astype(np.int64))], ["node", "linked"])


def _links(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, linked, exact) and (node, root) of the nodes that have links; exact are those compared in tiles."""
    near = written(graph.where(F.col("s") >= threshold).select("u", "v"), "near")
    roots = written(components(near.select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
    rooted = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    full = near.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("u").alias("node"))
    wide = written(rooted.join(full, "node", "left_semi").select("root").distinct(), "saturated")
    weighted = nodes.select("node", "copies", "embedding").join(rooted, "node")
    inside, across = _tiled(weighted.join(wide, "root", "left_semi"), threshold, partitions(nodes, per=1 << 20))
    both = near.union(near.select("v", "u")).distinct().join(rooted, F.col("u") == F.col("node")).join(wide, "root", "left_anti").select("u", "v")
    plain = both.join(nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("linked"))
    merged = components(across).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    rooted = rooted.join(merged, "root", "left").select("node", F.coalesce("whole", "root").alias("root"))
    degrees = inside.withColumn("exact", F.lit(True)).union(plain.withColumn("exact", F.lit(False)))
    return written(degrees, "degrees"), written(rooted, "rooted")


def audit(nodes: DataFrame, degrees: DataFrame, threshold: float, n: int = AUDIT) -> float:
    """The share found of a node's links by brute force, averaged over n nodes: the lesser of the averages of exact and of other nodes, so
    that neither large groups nor exact ones hide what others miss. The nodes, a fixed number, are those with the least hashes."""
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(n).select("node", "embedding").toArrow()
    if not asked.num_rows:
        return 1.0
    ids, q = asked.column(0).to_numpy(), unit(matrix(asked.column(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            m = unit(matrix(b.column(2), q.shape[1]))
            near = m[:, : q.shape[1]] @ q.T >= threshold
            near &= b.column(0).to_numpy()[:, None] != ids[None, :]
            total += b.column(1).to_numpy() @ near
        yield _degrees(ids, total)

    truth = nodes.select("node", "copies", "embedding").mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("truth"))
    share = F.least("truth", F.coalesce("linked", F.lit(0))) / F.col("truth")
    got = truth.where("truth > 0").join(degrees, "node", "left").groupBy(F.coalesce("exact", F.lit(False))).agg(F.avg(share).alias("recall")).collect()  # two rows
    return min((r["recall"] for r in got), default=1.0)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, k: int = K, seed: int = SEED) -> DataFrame:
    """rows: vec_id, embedding. Gives vec_id, n_links, component_id, kept for each row."""
    session(rows)
    good = finite() & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", "embedding")
    equal = rows.where(good).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = written(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, parts = nodes.count(), partitions(nodes, per=1 << 20)
    graph = written(first_lists(nodes, k, seed=seed), "graph")
    for turn in itertools.count(step=ROUNDS):
        for r in range(ROUNDS):
            graph = written(better(graph, nodes, k, parts, turn + r), "graph")
            if graph.where("new").count() <= STILL * n * k:
                break
        degrees, rooted = _links(graph, nodes, k, threshold)
        if (recall := audit(nodes, degrees, threshold)) >= RECALL:
            break
        if k >= n:
            raise RuntimeError(f"recall {recall:.3f} of the links with lists of all {n} nodes, {RECALL} wanted")
        k *= 2
        graph = graph.withColumn("new", F.lit(True))
    least = rooted.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    known = nodes.join(degrees, "node", "left").join(rooted.join(least, "root").drop("root"), "node", "left")
    known = written(known.select(F.col("embedding").alias("_e"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "known")
    # rows that link with nothing have no match among the nodes
    joined = rows.join(known, F.when(good, F.col("embedding")) == F.col("_e"), "left")
    component = F.when(F.col("_e").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM comp c LEFT JOIN deg d ON d.a = c.vec_id
"""
