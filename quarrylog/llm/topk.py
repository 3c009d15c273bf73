"""Exact top-k search by tiled matrix products.

Rows are packed into shards of SHARD vectors, queries into tiles of TILE. Shards are dealt to slots, as many as make a slot's shards fit
into HELD bytes, and at least two for each core; a copy of each tile travels to each slot. A task keeps its slot's shards and reads the
tiles one by one: each tile meets each shard in one matrix product, whose scores are cut to the k best of each query at once; the k-th
best so far rules out queries that the next shard can't better. The slots' lists are merged as a tree, FAN at a time. Queries aren't broadcast.

Components become floor(256 * x). Products of whole numbers are exact in double precision while sums stay below 2**53;
pairs of rows that could go beyond are scored with Python's integers, and a score beyond a long is held at its end.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled up with zeros. Null vec_ids
are no queries; as candidates they come last among ties. A candidate with the query's vec_id is the query's own row, so
repeated rows never find each other; each repeated query row gets its own list. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.common import session, written
from quarrylog.llm.vectors import finite, matrix

K = 5
EVERY = 50
SHARD = 4096
TILE = 512
#: Bytes of the shards of a slot, about.
HELD = 128 << 20
FAN = 32
SCALE = 256.0
_NO_ID = np.iinfo(np.int64).max
_EXACT = float(1 << 53)
_PACK = "pack long, ids binary, has_id binary, dims int, data binary"
_LISTS = "tile long, queries binary, ids binary, has_id binary, scores binary, counts binary"


def scaled(m: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * m)


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """rows (vec_id, embedding) packed, `size` to a row, which has a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)
        have: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(parts) -> pa.RecordBatch:
            dims = max(p[2].shape[1] for p in parts)
            data = np.concatenate([np.pad(p[2], ((0, 0), (0, dims - p[2].shape[1]))) for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([np.concatenate([p[0] for p in parts]).tobytes()]), pa.array([np.concatenate([p[1] for p in parts]).tobytes()]), pa.array([dims], pa.int32()), pa.array([data.tobytes()])], ["pack", "ids", "has_id", "dims", "data"])

        n = 0
        for b in batches:
            id_column = b.column(0)
            ids, known = id_column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), id_column.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            m = scaled(matrix(b.column(1)))
            at = 0
            while at < len(ids):
                some = slice(at, at + size - n)
                have.append((ids[some], known[some], m[some]))
                n += len(have[-1][0])
                at = some.stop
                if n >= size:
                    yield out(have)
                    have, n = [], 0
        if have:
            yield out(have)

    return rows.mapInArrow(run, _PACK)


def _inner(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as doubles, exact; if a pair of rows could go beyond 2**53 as Python integers, held within a long."""
    most = [np.abs(m).max(axis=1, initial=0.0) for m in (q, s)]
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ s.T
    if most[0].max(initial=0.0) * most[1].max(initial=0.0) * max(1, q.shape[1]) < _EXACT:
        return scores
    # a product of zeros is exact, however large the other rows are
    large = most[0][:, None] * most[1][None, :] * max(1, q.shape[1]) >= _EXACT
    out = np.where(large, 0, scores).astype(np.int64).astype(object)
    whole: dict[tuple[int, int], list[int]] = {}
    for i, j in zip(*np.nonzero(large), strict=True):
        r, t = (whole.get(at) or whole.setdefault(at, [int(x) for x in m[at[1]]]) for m, at in ((q, (0, int(i))), (s, (1, int(j)))))
        out[i, j] = max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(r, t, strict=True))))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the places of its k best, ties to smaller ids. NaN-free; -inf means no candidate."""
    if scores.dtype == object:
        return [np.array(sorted((c for c in range(len(ids)) if row[c] is not None), key=lambda c: (-row[c], ids[c]))[:k], np.int64) for row in scores]
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    edge = np.searchsorted(row, np.arange(len(scores) + 1))
    return [col[a : min(a + k, b)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _list_row(tile: int, queries: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    """found: ids, has_id, scores of each query."""
    cat = lambda k, kind: np.concatenate([f[k] for f in found]).astype(kind).tobytes() if found else b""
    return {"tile": tile, "queries": queries.tobytes(), "ids": cat(0, np.int64), "has_id": cat(1, np.uint8), "scores": cat(2, np.int64), "counts": np.array([len(f[0]) for f in found], np.int32).tobytes()}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"tile": pa.int64(), "part": pa.int64()}
    names = list(rows[0])
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in names], names)


_NONE = (np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64))


def _search(k: int):
    """Rows sorted by slot, a slot's shards first, then the tiles."""

    def listed(q_ids: np.ndarray, q: np.ndarray, shards: list) -> list:
        found = [_NONE] * len(q_ids)
        least = np.full(len(q_ids), -np.inf)  # the k-th best so far, rounded down where a double can't hold it
        for ids, known, s in shards:
            dims = max(q.shape[1], s.shape[1], 1)
            scores = _inner(*(np.pad(m, ((0, 0), (0, dims - m.shape[1]))) if m.shape[1] < dims else m for m in (q, s)))
            own = (q_ids[:, None] == ids[None, :]) & (known == 1)[None, :]
            scores[own] = None if scores.dtype == object else -np.inf
            hopeful = np.arange(len(q_ids)) if scores.dtype == object else np.nonzero(scores.max(axis=1, initial=-np.inf) >= least)[0]
            for n, c in zip(hopeful, _best(scores[hopeful], ids, k), strict=True):
                found[n] = _merged(found[n], (ids[c], known[c], scores[n, c].astype(np.int64)), k)
                if len(found[n][2]) == k:
                    least[n] = np.nextafter(float(found[n][2][-1]), -np.inf)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, shards = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["slot"] != slot:
                    slot, shards = r["slot"], []
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["has_id"], np.uint8)
                m = np.frombuffer(r["data"], np.float64).reshape(len(ids), -1)
                if r["asks"]:
                    yield _arrow([_list_row(r["pack"], ids, listed(ids, m, shards)) | {"part": slot // FAN}])
                else:
                    shards.append((ids, known, m))

    return run


def _unlisted(r: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    cut = np.cumsum(np.frombuffer(r["counts"], np.int32))[:-1]
    return list(zip(*(np.split(np.frombuffer(r[c], kind), cut) for c, kind in (("ids", np.int64), ("has_id", np.uint8), ("scores", np.int64))), strict=True))


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by tile and part: a merged list at a time
        key, now, queries = None, None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["tile"], r["part"]) != key:
                    if key is not None:
                        yield _arrow([_list_row(key[0], queries, now) | {"part": key[1] // FAN}])
                    key, now, queries = (r["tile"], r["part"]), _unlisted(r), np.frombuffer(r["queries"], np.int64)
                else:
                    now = [_merged(x, y, k) for x, y in zip(now, _unlisted(r), strict=True)]
        if key is not None:
            yield _arrow([_list_row(key[0], queries, now) | {"part": key[1] // FAN}])

    return run


def _merged(x, y, k: int):
    ids, known, scores = (np.concatenate(p) for p in zip(x, y, strict=True))
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == np.iinfo(np.int64).min else -scores))[:k]
    return ids[order], known[order], scores[order]


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """rows, queries: vec_id, embedding. Gives query_id, rank (from 1), vec_id, score."""
    session(rows)
    shards = written(_packs(rows.where(finite()).select("vec_id", "embedding"), SHARD), "shards")
    n = shards.count()
    tiles = written(_packs(queries.where(finite()).select("vec_id", "embedding"), TILE), "tiles")
    size = shards.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    slots = max(1, min(n, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // HELD))))
    # packs are numbered within their writers; with the packs of the writers before, a row a writer, all are numbered without gaps
    writer = F.shiftright("pack", 32)
    before = Window.orderBy("writer").rowsBetween(Window.unboundedPreceding, -1)
    first = written(shards.groupBy(writer.alias("writer")).agg(F.count("*").alias("n")).select("writer", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "writers")
    number = F.col("first") + F.col("pack").bitwiseAND(F.lit((1 << 32) - 1))
    dealt = shards.join(first, writer == F.col("writer")).withColumn("slot", F.pmod(number, F.lit(slots)).cast("int")).drop("writer", "first").withColumn("asks", F.lit(False))
    asked = tiles.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("asks", F.lit(True))
    work = max(16, slots)
    pairs = dealt.unionByName(asked).repartitionById(slots, "slot").sortWithinPartitions("slot", "asks", "pack")
    lists = pairs.mapInArrow(_search(k), _LISTS + ", part long")
    left = slots
    while True:
        dealt = written(lists, "top-lists").repartition(work, "tile", "part").sortWithinPartitions("tile", "part")
        lists = dealt.mapInArrow(_merge(k), _LISTS + ", part long")
        left = -(-left // FAN)
        if left <= 1:
            return lists.mapInArrow(_rows, "query_id long, rank int, vec_id long, score long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            queries, found = np.frombuffer(r["queries"], np.int64), _unlisted(r)
            n = np.array([len(f[0]) for f in found])
            if not n.sum():
                continue
            ids, known, scores = (np.concatenate([f[c] for f in found]) for c in range(3))
            rank = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, n)), pa.array(rank.astype(np.int32)), pa.array(ids, mask=known == 0), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])


def op10_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""
