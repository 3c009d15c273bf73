"""Byte-level BPE by a table of distinct words.

1. Documents are read in blocks of about BLOCK bytes. A block's texts are split into words, and a document becomes positions in
   the block's list of distinct words. Blocks are written once, as a table bucketed by block.
2. The blocks' lists are dealt by a hash of the word, so that every occurrence of a word meets in one bucket, and each distinct
   word is encoded once. A list is a packed row for each block and bucket, and holds a word once however frequent it is.
3. Ids go back to their block and are joined by position. Only the lists travel; the blocks' table is already dealt by block.
4. Decoding joins ids to pieces; that table has a row for each id of the tokenizer (some 50,000), so each worker holds it whole.

Words end before an ASCII space that a non-space character follows: the tokenizer's own split always ends there as well,
so encoding words alone equals encoding the text. Special tokens in a text are words of their own. White space of other kinds
stays inside a word. Buckets grow with the input, so that one's distinct words fit in a worker.

Nulls: a null text is empty and has no ids; null doc_ids are kept. Repeated rows give repeated rows. Empty tables give empty results.
Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import Numbers, column, partitions, plan_bytes, session, texts

#: Bytes of text in a block, about. A longer text is a block alone.
BLOCK = 8 << 20
#: Ends a word in a packed list; no UTF-8 text holds this byte.
END = b"\xff"

_BLOCKS = "block long, doc_ids array<long>, n_words array<int>, codes binary, lists array<struct<bucket: int, words: binary>>"
_ENCODED = "block long, bucket int, lengths binary, ids binary"


@functools.lru_cache(maxsize=2)
def tokenizer(file: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@functools.lru_cache(maxsize=2)
def specials(file: str) -> re.Pattern | None:
    names = [t.content for t in tokenizer(file).get_added_tokens_decoder().values()]
    return re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if names else None


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def pieces(file: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id."""
    byte = byte_alphabet()
    table = [b""] * tokenizer(file).get_vocab_size(with_added_tokens=True)
    for piece, k in tokenizer(file).get_vocab(with_added_tokens=True).items():
        table[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return table


@functools.lru_cache(maxsize=2)
def decimals(n: int) -> list[bytes]:
    return [b"%d" % k for k in range(n)]


# --- splitting ---------------------------------------------------------------------------------------------------------------


def _split_plain(text: str) -> list[str]:
    parts = text.split(" ")
    if len(parts) == 1:
        return [text] if text else []
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out if out[0] else out[1:]


def split(text: str, special: re.Pattern | None = None) -> list[str]:
    """The text's words; joined, they are the text."""
    if special is None or not special.search(text):
        return _split_plain(text)
    return [w for k, part in enumerate(special.split(text)) for w in ([part] if k % 2 else _split_plain(part))]


@functools.lru_cache(maxsize=1)
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=6)


def _packed(codes: np.ndarray) -> bytes:
    """Byte planes: they compress better than whole numbers."""
    return _zstd()[0].compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    data = _zstd()[1].decompress(data)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class _Block:
    def __init__(self):
        self.word = Numbers()
        self.codes: list[np.ndarray] = []
        self.doc_ids: list = []
        self.n_words: list[int] = []
        self.bytes = 0

    def add(self, doc_id, text: str, special) -> None:
        words = split(text, special)
        self.codes.append(np.fromiter(map(self.word.__getitem__, words), np.uint32, len(words)))
        self.doc_ids.append(doc_id)
        self.n_words.append(len(words))
        self.bytes += len(text)

    def row(self, block: int, buckets: int) -> dict[str, list]:
        words = [w.encode("utf-8", "replace") for w in self.word]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)  # sorted lists compress better
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.int64)
        found, first = np.unique(bucket[order], return_index=True)
        lists = [{"bucket": int(b), "words": _zstd()[2].compress(END.join(words[k] for k in some))} for b, some in zip(found, np.split(order, first[1:]), strict=True)] if len(words) else []
        return {"block": [block], "doc_ids": [self.doc_ids], "n_words": [self.n_words], "codes": [_packed(place[codes] if len(codes) else codes)], "lists": [lists]}


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("codes", pa.binary()), ("lists", pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))]
)


def blocks(docs: DataFrame, file: str, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, first, special = _Block(), TaskContext.get().partitionId() << 32, specials(file)
        for b in batches:
            for doc_id, text in zip(column(b, "doc_id"), texts(b), strict=True):
                block.add(doc_id, text, special)
                if block.bytes >= BLOCK:
                    yield pa.RecordBatch.from_pydict(block.row(first, buckets), _BLOCK_SCHEMA)
                    block, first = _Block(), first + 1
        if block.doc_ids:
            yield pa.RecordBatch.from_pydict(block.row(first, buckets), _BLOCK_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCKS)


# --- encoding ----------------------------------------------------------------------------------------------------------------


def _encode_lists(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known, flat, start, length = tokenizer(file), {}, [], [], []
        used = 0
        flat_array = start_array = length_array = None
        for b in batches:
            for block, bucket, packed in zip(column(b, "block"), column(b, "bucket"), column(b, "words"), strict=True):
                words = _zstd()[1].decompress(packed).split(END)
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 20_000):
                    some = new[at : at + 20_000]
                    for w, e in zip(some, coder.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                        known[w] = len(start)
                        ids = e.ids
                        flat.extend(ids)
                        start.append(used)
                        length.append(len(ids))
                        used += len(ids)
                if new or flat_array is None:
                    flat_array = _grown(flat_array, flat, np.uint32)
                    start_array, length_array = _grown(start_array, start, np.int64), _grown(length_array, length, np.uint32)
                k = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                n = length_array[: len(start)][k].astype(np.int64)
                ends = np.cumsum(n)
                ids = flat_array[np.repeat(start_array[k] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_packed(n)], pa.binary()), pa.array([_packed(ids)], pa.binary())], ["block", "bucket", "lengths", "ids"])

    return run


def _grown(array: np.ndarray | None, values: list, kind) -> np.ndarray:
    """values as an array; what the array has already isn't converted again."""
    have = 0 if array is None else len(array)
    more = np.array(values[have:], kind)
    return more if array is None else np.concatenate([array, more]) if len(more) else array


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """A row for each block: doc_ids, n_words, codes (positions of each document's words), encoded (ids of the block's distinct words)."""
    spark = session(docs)
    buckets = partitions(docs, per=4 << 20, least=48)
    n = int(min(max(16, plan_bytes(docs) // BLOCK + 1), 100_000))  # as many buckets as Spark allows
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    blocks(docs, file, buckets).write.option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    table = spark.table(name)
    lists = table.select("block", F.explode("lists").alias("l")).select("block", "l.bucket", "l.words")
    done = lists.repartition(buckets, "bucket").mapInArrow(_encode_lists(file), _ENCODED)
    back = done.repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "lengths", "ids")).alias("encoded"))
    return table.select("block", "doc_ids", "n_words", "codes").hint("merge").join(back, "block", "left")


def _documents(b: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    """The ids of each document of the blocks in b."""
    for doc_ids, n_words, codes, found in zip(*(column(b, c) for c in ("doc_ids", "n_words", "codes", "encoded")), strict=True):
        found = sorted(found or [], key=lambda x: x["bucket"])
        length = np.concatenate([_unpacked(x["lengths"]) for x in found]) if found else np.empty(0, np.int64)
        flat = np.concatenate([_unpacked(x["ids"]) for x in found]) if found else np.empty(0, np.int64)
        start, codes, at = np.cumsum(length) - length, _unpacked(codes), 0
        for doc_id, words in zip(doc_ids, n_words, strict=True):
            k = codes[at : at + words]
            at += words
            n = length[k]
            ends = np.cumsum(n)
            yield doc_id, flat[np.repeat(start[k] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def token_ids(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, ids = [], []
            for doc_id, found in _documents(b):
                doc_ids.append(doc_id)
                ids.append(found.astype(np.int32))
                if len(ids) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                    doc_ids, ids = [], []
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encoded(docs, file).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of ids, special tokens included."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decoded(tokens: DataFrame, file: str) -> DataFrame:
    """doc_id, text for each row of tokens (doc_id, ids)."""
    session(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode(np.array(x or [], np.int64), pieces(file)) for x in column(b, "ids")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(file)
        number = decimals(len(table))
        for b in batches:
            rows = [
                (doc_id, len(ids), hashlib.sha256(b",".join(map(number.__getitem__, ids.tolist()))).hexdigest(), hashlib.sha256(decode(ids, table).encode()).hexdigest())
                for doc_id, ids in _documents(b)
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, file).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
