"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A data file begins with a header (magic, bytes per id) and holds records in ascending doc_id order:

    u64 length of the payload | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

The payload is a flag byte (1: doc_id is null), the doc_id as i64, and the ids, two bytes each if the vocabulary fits in them, else four. An index
file has an i64 doc_id, u64 offset and u32 length for each record, so that a shuffled read seeks straight to a record
(read_record). All numbers are little-endian; a checksum is masked as rotate-right(crc, 15) + 0xA282EAD8, so that checksums of data that
holds checksums stay strong.

Documents are range-partitioned by doc_id; each partition writes one file in the shared folder under a name of its own attempt, and
the manifest (a row a file) names the files of the attempts that counted. A lost executor's partition is written again under a
new name. Global starts are a running sum over the manifest, a row a file.

Encoding: a word between ASCII white space is encoded alone, which is exact for tokenizers that drop white space before they split
(splits_words tells; texts are encoded whole by others); each worker keeps the ids of the words it has met, bounded by WORDS. Texts are read whole, in Arrow batches bounded by bytes.

Nulls: a null text has the end id alone; null doc_ids come first. Equal doc_ids are ordered by a hash of the text, repeated rows by their place. Empty tables write
nothing and give no rows. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.common import Numbers, column, new_path, partitions, session, texts, written

END_ID = 2
#: Most words a worker remembers; then it starts anew.
WORDS = 1_500_000
MAGIC = b"TOKREC1\0"
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


# --- the format ------------------------------------------------------------------------------------------------------------


def header(width: int) -> bytes:
    return MAGIC + bytes([width])


def record(doc_id: int | None, ids: bytes) -> bytes:
    payload = struct.pack("<Bq", doc_id is None, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _unpacked(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    null, doc_id = struct.unpack_from("<Bq", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def _payload(stream) -> bytes | None:
    head = stream.read(12)
    if not head:
        return None
    length, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("a record's length doesn't match its checksum")
    payload = stream.read(length)
    if struct.unpack("<I", stream.read(4))[0] != masked(payload):
        raise ValueError("a record doesn't match its checksum")
    return payload


def _width(stream) -> int:
    head = stream.read(len(MAGIC) + 1)
    if head[:-1] != MAGIC:
        raise ValueError("not a token file")
    return head[-1]


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a data file, in order."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
        width = _width(stream)
        while (payload := _payload(stream)) is not None:
            yield _unpacked(payload, width)


def read_index(uri: str) -> np.ndarray:
    """The index of a data file: doc_id, offset, length."""
    fs, path = pa.fs.FileSystem.from_uri(uri + ".idx")
    with fs.open_input_stream(path) as stream:
        return np.frombuffer(stream.read(), [("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4")])


def read_record(uri: str, offset: int) -> tuple[int | None, np.ndarray]:
    """The record that begins at offset, by one seek."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        width = _width(file)
        file.seek(int(offset))
        return _unpacked(_payload(file), width)


# --- encoding ---------------------------------------------------------------------------------------------------------------


def splits_words(ids) -> bool:
    """If a tokenizer, by its ids of some probes, drops white space and ASCII case before it splits, and parts sentence marks from what they follow."""
    words = ("Word", "x9", "ÜBER", "it's", "a-b", "7", "naïve_", "東京", "(so)", "e\u0301")
    marks = (".", ",", "...", ",,.")
    apart = all(ids(f"{a}{gap}{b}") == ids(a.lower() if a.isascii() else a) + ids(b) for a in words for b in words for gap in (" ", "\t \r\n", "\x0b\x0c  "))
    return apart and all(ids(w + m) == ids(w) + ids(m) for w in words if w[-1].isalnum() for m in marks) and ids(" a ") == ids("a") and ids("") == []


class WordEncoder:
    """Ids of whole texts: by way of the distinct words if the tokenizer splits words so that this is exact, else of each text."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_words = splits_words(lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids)
        self._forget()

    def _forget(self) -> None:
        self.at = Numbers()
        self.flat = np.empty(1 << 16, np.uint32)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.known = 0

    def _add(self, words: list[bytes]) -> None:
        """Encodes words that have their numbers already."""
        flat: list[int] = []
        lengths = []
        for at in range(0, len(words), 10_000):
            for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[at : at + 10_000]], add_special_tokens=False):
                ids = e.ids
                flat += ids
                lengths.append(len(ids))
        self._append(np.array(flat, np.uint32), np.array(lengths, np.int64), np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)))

    def _append(self, flat: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.at) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(flat)

    def _learn(self, new: list[bytes]) -> None:
        # sentence marks after a letter or digit are pieces of their own, so only what stands before them is encoded
        marked = [w for w in new if w[-1] in b".," and w.rstrip(b".,")[-1:].isalnum()]
        whole = [w for w in new if not (w[-1] in b".," and w.rstrip(b".,")[-1:].isalnum())]
        cores = [w.rstrip(b".,") for w in marked]
        find = self.at.__getitem__
        core = np.fromiter(map(find, cores), np.int64, len(cores))
        tail = np.fromiter((find(w[len(c) :]) for w, c in zip(marked, cores, strict=True)), np.int64, len(cores))
        self._add(whole + self.at.take())
        if marked:
            both = np.stack([core, tail], 1).reshape(-1)
            lengths = self.length[core] + self.length[tail]
            self._append(self._gather(both), lengths, np.fromiter(map(find, marked), np.int64, len(marked)))

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        n = self.length[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[numbers] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode_all(self, some: list[str]) -> Iterator[np.ndarray]:
        if not self.by_words:
            for t in some:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            return
        if len(self.at) > WORDS:
            self._forget()
        find = self.at.__getitem__
        numbers = []
        for t in some:
            b = t.encode("utf-8", "replace")
            # ASCII letters are lower-cased here already, as the tokenizer would; fewer words are distinct then.
            # Special tokens are matched before lower-casing, so texts that may hold one stay as they are.
            words = (b if b"<|" in b else b.lower()).split()
            numbers.append(np.fromiter(map(find, words), np.int64, len(words)))
        if new := self.at.take():
            self._learn(new)
        for k in numbers:
            yield self._gather(k)


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


# --- writing and reading with Spark -----------------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes the token files of docs (doc_id, text); gives the manifest: part, uri, n_records, n_tokens, first (tokens in all files before)."""
    spark = session(docs)
    path = path or new_path(spark, "tokens")
    pa.fs.FileSystem.from_uri(path)[0].create_dir(pa.fs.FileSystem.from_uri(path)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer_file)
        width = 2 if max(coder.size, end_id + 1) <= 1 << 16 else 4
        uri = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        fs, at = pa.fs.FileSystem.from_uri(uri)
        rows = tokens = 0
        end = np.array([end_id], f"<u{width}").tobytes()
        data = index = None
        for b in batches:
            if not b.num_rows:
                continue
            if data is None:
                data, index = fs.open_output_stream(at), fs.open_output_stream(at + ".idx")
                data.write(header(width))
                offset = len(header(width))
            out, found = [], []
            for doc_id, ids in zip(column(b, "doc_id"), coder.encode_all(texts(b)), strict=True):
                r = record(doc_id, ids.astype(f"<u{width}").tobytes() + end)
                out.append(r)
                found.append(struct.pack("<qQI", doc_id or 0, offset, len(r)))
                offset += len(r)
                rows, tokens = rows + 1, tokens + len(ids) + 1
            data.write(b"".join(out))
            index.write(b"".join(found))
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), pa.array([rows], pa.int64()), pa.array([tokens], pa.int64())], ["part", "uri", "n_records", "n_tokens"])

    # a row's place parts repeated rows, of which there may be more than one file should hold
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_place"))
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_place"))
    rows = placed.repartitionByRange(partitions(docs, per=16 << 20), *order).sortWithinPartitions(*order).drop("_place")
    manifest = written(rows.mapInArrow(run, "part long, uri string, n_records long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """A row for each record of the files: doc_id, start, n_tokens, ids_crc32. Every checksum is tested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(column(b, "uri"), column(b, "first"), strict=True):
                rows = []
                for doc_id, ids in read_file(uri):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    session(manifest)
    files = written(manifest.select("part", "uri", "first"), "manifest")
    return files.repartition(max(16, min(20_000, files.count())), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, public_tokenizers.path("word_bpe_49k.json")))
