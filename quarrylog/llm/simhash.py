"""SimHash near-duplicates: fingerprints of word shingles, linked within a radius by bit-sliced comparison.

Fingerprint: a bit is 1 if it is set in over half of the shingles' hashes. Documents with one fingerprint are a class; from there
on only distinct fingerprints move, so a group of copies of any size costs one row.

Candidates: 64 bits are cut into `parts` runs. Two fingerprints at distance <= radius agree in at least
parts - radius runs, so each choice of that many runs is a table, and its bits a key; every pair within the radius meets in some
bucket (exact, by pigeonhole). `parts` grows with the number of fingerprints so that buckets stay small. A bucket
over TILE rows is cut into tiles and each pair of tiles is a group of its own, so no group is unbounded, and no pair is lost.

Comparison inside a group: bit planes are stored vertically, 64 fingerprints to a machine word. For each fingerprint and word the
differing lanes of plane after plane are added to carry-save bit counters; every few planes, words whose lanes all
exceed the radius are abandoned. Lanes left after all planes are links. A group returns a spanning forest of its links, at most
a row for each fingerprint in it.

Nulls: a null text is empty; an empty or blank text has fingerprint zero and links like any other. Null doc_ids never are the
smallest id; a component of null ids alone has a null id. Repeated rows share a fingerprint. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import Carried, partitions, session, texts, written
from quarrylog.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Most fingerprints on one side of a group's comparison.
TILE = 8192
#: Fingerprints that should share a bucket, about; more make `parts` grow.
BUCKET = 2048
#: Words (of 64 lanes) compared at once.
CHUNK = 1 << 14
#: Planes after which finished words are abandoned.
LOOKS = (10, 16, 22, 30, 40, 52, 64)

_ASCII_SPACE = b" \t\n\r\x0b\x0c"


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    # bytes.lower() and bytes.split() know ASCII alone, as the definition does
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 65536):
        some = slice(at, min(at + 65536, n))
        cut = zip(starts[some].tolist(), ends[some.start + shingle - 1 : some.stop + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], seed) for i, j in cut], np.uint64)
        total += _bit_counts(hashes)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit. Eight bits are counted at a time in the bytes of a word."""
    spread = np.uint64(0x0101010101010101)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16 * 255):
        block = hashes[at : at + 16 * 255]
        block = np.concatenate([block, np.zeros(-len(block) % 16, np.uint64)]).reshape(-1, 16)
        for bit in range(8):
            total[bit::8] += ((block >> np.uint64(bit)) & spread).sum(0, dtype=np.uint64).view(np.uint8).reshape(16, 8).sum(0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """The columns `keep` (doc_id alone, unless given) and _fp, the fingerprint as a signed long."""
    session(docs)
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in texts(b, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], [*keep, "_fp"])

    rows = docs.select(*dict.fromkeys([*keep, text]))
    return rows.mapInArrow(run, _with([rows.schema[c] for c in keep], "_fp"))


def _with(fields, name):
    from pyspark.sql import types as T

    return T.StructType([*fields, T.StructField(name, T.LongType())])


# --- candidates --------------------------------------------------------------------------------------------------------


def parts_for(n: int, radius: int = RADIUS) -> int:
    """The fewest runs for which the expected bucket is at most BUCKET."""
    for parts in range(radius + 1, 64):
        if n / 2.0 ** (64 * (parts - radius) / parts) <= BUCKET:
            return parts
    return 63


def _masks(parts: int, radius: int) -> list[int]:
    edge = [round(64 * k / parts) for k in range(parts + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edge)]
    return [sum(c) for c in itertools.combinations(runs, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct fingerprints (_fp) dealt to groups: columns _table, _key, _a, _b (tiles), _mine (the row's own tile), _fp."""
    masks = _masks(parts_for(n, radius), radius)
    rows = distinct.select("_fp", F.posexplode(F.array(*(F.col("_fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("_table", "_key"))
    hot = written(rows.groupBy("_table", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > tile), "hot-buckets")
    # a row for each bucket of over `tile` fingerprints: the planner broadcasts them if their file is small
    rows = rows.join(hot, ["_table", "_key"], "left")
    tiles = F.coalesce(F.ceil(F.col("_n") / F.lit(tile)), F.lit(1)).cast("int")
    rows = rows.withColumn("_tiles", tiles).withColumn("_mine", F.pmod(F.xxhash64("_fp"), F.col("_tiles")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return rows.select("_table", "_key", F.least("_mine", "_o").alias("_a"), F.greatest("_mine", "_o").alias("_b"), "_mine", "_fp")


# --- bit-sliced comparison -----------------------------------------------------------------------------------------------


def planes_of(fps: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bit planes (64, words) of groups that start at `first` and take `width` rows; each group begins a new word."""
    words = (width + 63) // 64
    place = np.arange(len(fps)) - np.repeat(first, width) + np.repeat((np.cumsum(words) - words) * 64, width)
    out = np.empty((64, int(words.sum())), np.uint64)
    for bit in range(64):
        lanes = np.zeros(int(words.sum()) * 64, np.uint8)
        lanes[place] = ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        out[bit] = np.packbits(lanes, bitorder="little").view("<u8")
    return out


def near_pairs(fps: np.ndarray, width: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows of one group at distance <= radius. The rows of a group are adjacent; width: the groups' sizes."""
    first = np.cumsum(width) - width
    planes = planes_of(fps, first, width)
    words = (width + 63) // 64
    base = np.cumsum(words) - words  # a group's first word
    at_row = np.arange(len(fps)) - np.repeat(first, width)
    least = at_row // 64  # a row is compared with its own word and later ones
    cells = np.repeat(words, width) - least
    ends = np.cumsum(cells)
    group = np.repeat(np.arange(len(width)), width)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        cell = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
        row = np.searchsorted(ends, cell, side="right")
        word = least[row] + cell - (ends[row] - cells[row])  # within the group
        lane0 = word * 64
        g = group[row]
        own = at_row[row]
        valid = np.full(len(cell), ~np.uint64(0))
        room = width[g] - lane0
        short = room < 64
        valid[short] = (np.uint64(1) << room[short].astype(np.uint64)) - np.uint64(1)
        same = own >= lane0  # in its own word, lanes up to itself are left out
        drop = (own - lane0 + 1)[same].astype(np.uint64)
        low = np.where(drop >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(drop, np.uint64(63))) - np.uint64(1))
        valid[same] &= ~low
        row, word = row[valid != 0], (base[g] + word)[valid != 0]
        valid = valid[valid != 0]
        counts = [np.zeros(len(row), np.uint64) for _ in range(max(1, math.ceil(math.log2(radius + 1))))]
        over = ~valid
        done = 0
        for look in LOOKS:
            mine = fps[row]
            for bit in range(done, look):
                carry = planes[bit][word] ^ (np.uint64(0) - ((mine >> np.uint64(bit)) & np.uint64(1)))
                for k, c in enumerate(counts):  # carry-save: each counter is a plane of lane counts
                    counts[k], carry = c ^ carry, c & carry
                over |= carry
            done = look
            alive = ~(over | _exceeds(counts, radius)) != 0
            if not alive.all():
                row, word, over, counts = row[alive], word[alive], over[alive], [c[alive] for c in counts]
            if not len(row):
                break
        if len(row):
            lanes = np.unpackbits((~(over | _exceeds(counts, radius))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            g = group[row[k]]
            yield row[k], first[g] + (word[k] - base[g]) * 64 + lane


def _exceeds(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over the radius: a bitwise comparison from the highest counter down."""
    more, equal = np.zeros_like(counts[0]), np.full_like(counts[0], ~np.uint64(0))
    for k in reversed(range(len(counts))):
        if radius >> k & 1:
            equal = equal & counts[k]
        else:
            more, equal = more | (equal & counts[k]), equal & ~counts[k]
    return more


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each of n rows is connected to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            if not (differ := hi != lo).any():
                break
            np.minimum.at(root, hi[differ], lo[differ])
            while (root[root] != root).any():
                root = root[root]
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Whole groups, many at once: the columns of batches sorted by their first `keys` columns, cut where a group ends."""
    rest: list[np.ndarray] | None = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if rest is None:
            return
        if b is None:
            yield rest
            return
        change = np.any([c[1:] != c[:-1] for c in rest[:keys]], axis=0)
        if len(rest[0]) >= most and change.any():
            cut = int(np.nonzero(change)[0][-1]) + 1
            yield [c[:cut] for c in rest]
            rest = [c[cut:] for c in rest]


def links(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A spanning forest (a, b) of each group's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key, a, b, mine, fp in _groups(batches, 4):
            fps = fp.view(np.uint64)
            change = np.any([c[1:] != c[:-1] for c in (table, key, a, b)], axis=0)
            width = np.diff(np.concatenate(([0], np.nonzero(change)[0] + 1, [len(fps)])))
            pairs = near_pairs(fps, width, radius)
            root = forest(len(fps), pairs)
            linked = np.nonzero(root != np.arange(len(fps)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["a", "b"])

    dealt = buckets(distinct, n, radius, tile)
    keys = ["_table", "_key", "_a", "_b"]
    return dealt.repartition(partitions(distinct, per=1 << 20), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """prints: doc_id, _fp. Gives _fp, _root (the least fingerprint reached), component_id (smallest doc_id reached): a row for each fingerprint."""
    distinct = written(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "fingerprints")
    found = components(links(distinct.select("_fp"), distinct.count(), radius, tile))
    rooted = distinct.join(found, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("_root"), "_least")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return written(rooted.select("_fp", "_root").join(least, "_root"), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of docs."""
    prints = written(fingerprints(docs, shingle=shingle, seed=seed), "prints")
    rows = prints.join(classes(prints, radius), "_fp")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id; among repeated rows of that id, the first written.

    What stays is decided on ids, fingerprints and row numbers, summed to a row a fingerprint; the documents then meet a row number
    each, so that the texts of a group of copies never gather."""
    c = Carried(docs)
    prints = fingerprints(c.rows, c.own, shingle, seed, c["text"])
    prints = written(prints.withColumn("_row", F.monotonically_increasing_id()), "prints-kept")
    doc_id = F.col(c["doc_id"])
    roots = classes(prints.select(doc_id.alias("doc_id"), "_fp"), radius).select("_fp", "_root")
    first = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("_row").alias("row")))
    least = prints.groupBy("_fp").agg(first.alias("least")).join(roots, "_fp")
    kept = written(least.groupBy("_root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_row")), "kept-rows")
    # no broadcast: row numbers grow with the documents
    return c.back(prints.join(kept.hint("merge"), "_row", "left_semi"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
