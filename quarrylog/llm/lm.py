"""Masked pseudo-likelihood by a bidirectional window network trained in numpy.

Words (lower-cased ASCII, parted by ASCII white space) are counted over all documents: counts are summed in each task, then on the cluster. The
most frequent words are symbols of their own; every other word shares one of OTHERS symbols by its ending. For each token
the network sees WIDTH symbols on either side, not the token itself: embeddings, a tanh layer, and a softmax in two levels
(a class of symbols, a symbol in the class). A document's score is the sum over its tokens of

    ln( MIX * p_network(symbol | both sides) + (1 - MIX) * p_corpus(symbol) ) + ln p(word | symbol)

where p_corpus comes from the counts of the whole corpus, and so does p(word | symbol): n(word) / (n(symbol) + 1), with the share
1 / (n(symbol) + 1) kept for words not in the corpus. The vocabulary are all words of the corpus; the counts of the rarer ones are
joined to the documents. Only the symbol depends on the sides. The network is trained on every document, on the executors: documents are
dealt by hash to groups of about GROUP tokens, so that their number grows with the corpus; each group trains from the same
network, and the groups' networks are averaged (as a tree) and start the next range of SHARES. Ranges and PASSES are the same for any number of
groups, one included: no size of the corpus changes the schedule.

Nulls: a null text has no words, score 0 and mean 0; null doc_ids are kept. Repeated rows score alike, and count in training as often as they occur. Empty tables give
empty results; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.common import session, written

CLASSES = MEMBERS = 32
SIZE = CLASSES * MEMBERS
OTHERS = 256
WIDTH = 2
EMBED, HIDDEN = 16, 32
#: Tokens of one group of documents, which one task trains on, and of the part of it that is shuffled at once.
GROUP, HELD = 4_000_000, 1 << 18
#: After the documents of each of these ranges of hashes the groups' networks are averaged.
SHARES = (0, 1, 4, 10, 16)
#: Passes over the documents of each range, at every size: more while the networks are new. A caller may give others.
PASSES = (2, 2, 1, 1)
BATCH, SEED = 4096, 23
MIX = 0.9
PAD = SIZE
#: Distinct words of batches that a task holds before it sums and sends them.
FLUSH = 1_000_000
CHUNK = 1 << 13
#: Words whose counts the executors hold for scoring; those of all others come by a join.
FREQUENT = 1 << 18
#: Most tasks that train groups at once, and networks that one task or the driver sums: they are summed as a tree.
TASKS, FAN = 20_000, 32


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """words() of a column of texts: how many each text has, all of them as places in the list of distinct ones, and that list."""
    column = column.cast(pa.string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    n, found = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().cast(pa.binary()).dictionary_encode()
    at = found.indices.to_numpy(zero_copy_only=False)
    if (blank := found.dictionary.index(pa.scalar(b"", pa.binary())).as_py()) >= 0:  # beside white space at the ends of a text
        kept = at != blank
        n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
        at = at[kept]
    return n, at, found.dictionary


class Symbols(dict):
    """The symbol of each frequent word; any other word's comes from its ending."""

    def __missing__(self, word: bytes) -> int:
        return SIZE - OTHERS + zlib.crc32(word[-3:]) % OTHERS

    def of(self, some: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), np.int64, len(some))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> list[pa.RecordBatch]:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

        for b in batches:
            _, at, distinct = coded(b.column(0))
            times = np.bincount(at, minlength=len(distinct))
            held.append(pa.table({"word": distinct, "n": times}).filter(pa.array(times > 0)))
            rows += len(distinct)
            if rows > FLUSH:
                yield from out()
                held, rows = [], 0
        if held:
            yield from out()

    session(docs)
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _context(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The symbols around each token of sequences, of n tokens each, left then right; sequences don't see one another."""
    at = np.arange(len(s)) + WIDTH * (1 + np.repeat(np.arange(len(n)), n))
    wide = np.full(len(s) + WIDTH * (len(n) + 1), PAD, np.int16)
    wide[at] = s
    return np.stack([wide.take(at + k) for k in range(-WIDTH, WIDTH + 1) if k], 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of columns, in place. Reductions over the first axis run along the memory, which those over short rows don't."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each column at one place; z is overwritten."""
    z -= z.max(0)
    found = z[at, np.arange(len(at))]
    np.exp(z, out=z)
    return found - np.log(z.sum(0))


def _runs(cls: np.ndarray) -> list[tuple[int, int, int]]:
    """The classes (sorted) that occur, each with its range of places."""
    edge = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return [(k, lo, hi) for k, (lo, hi) in enumerate(itertools.pairwise(edge)) if lo < hi]


class Network:
    """p: embed (symbols + PAD), first (2 * WIDTH layers), bias, cls, cls_bias, member, member_bias (for each class)."""

    def __init__(self, corpus: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (0.3 * rng.standard_normal(shape)).astype(np.float32)
        self.log_corpus = np.log(corpus / corpus.sum())
        by_class = corpus.reshape(CLASSES, MEMBERS)
        self.p = {
            "embed": draw(SIZE + 1, EMBED), "first": draw(2 * WIDTH, EMBED, HIDDEN), "bias": np.zeros(HIDDEN, np.float32),
            "cls": draw(HIDDEN, CLASSES) * 0.1, "cls_bias": np.log(by_class.sum(1) / corpus.sum()).astype(np.float32),
            "member": draw(CLASSES, HIDDEN, MEMBERS) * 0.1, "member_bias": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        }
        self.corpus, self.tokens = corpus, 0  # tokens trained on
        self.past = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    def tables(self) -> np.ndarray:
        return np.stack([self.p["embed"] @ w for w in self.p["first"]])

    def log_probs(self, parts: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
        """ln p of each token of the sequences, given both of its sides."""
        s = np.concatenate([np.empty(0, np.int64), *parts])
        out = np.empty(len(s))
        around = _context(s, np.array([len(x) for x in parts], np.int64))
        for at in range(0, len(s), CHUNK):
            order = np.argsort((s[at : at + CHUNK] // MEMBERS).astype(np.int16), kind="stable")  # classes are runs
            c, y = around[at : at + CHUNK][order], s[at : at + CHUNK][order]
            cls, member = np.divmod(y, MEMBERS)
            z = tables[0].take(c[:, 0], axis=0)
            z += self.p["bias"]
            for k in range(1, 2 * WIDTH):
                z += tables[k].take(c[:, k], axis=0)
            h = np.tanh(z, out=z).T
            lp = _log_softmax_at(self.p["cls"].T @ h + self.p["cls_bias"][:, None], cls)
            z = np.empty((MEMBERS, len(y)), np.float32)
            for k, lo, hi in _runs(cls):
                np.add(self.p["member"][k].T @ h[:, lo:hi], self.p["member_bias"][k][:, None], out=z[:, lo:hi])
            lp = lp.astype(float) + _log_softmax_at(z, member)
            out[at + order] = np.logaddexp(np.log(MIX) + lp, np.log(1 - MIX) + self.log_corpus[y])
        return out

    def sums(self, parts: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
        """ln p of each sequence."""
        n = [len(x) for x in parts]
        return np.bincount(np.repeat(np.arange(len(n)), n), self.log_probs(parts, tables), minlength=len(n))

    def fit(self, sequences: list[np.ndarray], epochs: int = 1, seed: int = SEED) -> None:
        """Passes of Adagrad, whose sums of squares stay in self.past."""
        if not sum(map(len, sequences)):
            return
        y = np.concatenate(sequences)
        x = _context(y, np.array([len(s) for s in sequences], np.int64))
        rng, p, past = np.random.default_rng(seed), self.p, self.past
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                some = order[at : at + BATCH]
                some = some[np.argsort((y[some] // MEMBERS).astype(np.int16), kind="stable")]  # classes are runs
                c, t = x[some], y[some]
                n, (cls, member) = len(t), np.divmod(t, MEMBERS)
                seen = p["embed"].take(c, axis=0).reshape(n, -1)
                first = p["first"].reshape(-1, HIDDEN)
                # columns are tokens from here on
                h = seen @ first
                h += p["bias"]
                h = np.tanh(h, out=h).T
                g = {k: np.zeros_like(p[k]) for k in ("member", "member_bias", "embed")}
                d = _softmax(p["cls"].T @ h + p["cls_bias"][:, None])
                d[cls, np.arange(n)] -= 1
                g["cls"], g["cls_bias"], dh = h @ d.T, d.sum(1), p["cls"] @ d
                runs = _runs(cls)
                z = np.empty((MEMBERS, n), np.float32)
                for k, lo, hi in runs:
                    np.add(p["member"][k].T @ h[:, lo:hi], p["member_bias"][k][:, None], out=z[:, lo:hi])
                d = _softmax(z)
                d[member, np.arange(n)] -= 1
                for k, lo, hi in runs:
                    g["member"][k] = h[:, lo:hi] @ d[:, lo:hi].T
                    dh[:, lo:hi] += p["member"][k] @ d[:, lo:hi]
                g["member_bias"][[k for k, _, _ in runs]] = np.add.reduceat(d, [lo for _, lo, _ in runs], axis=1).T
                dz = np.subtract(1, h * h)
                dz *= dh
                g["bias"], g["first"] = dz.sum(1), (seen.T @ dz.T).reshape(p["first"].shape)
                back = (dz.T @ first.T).reshape(-1, EMBED)
                flat = c.reshape(-1)
                by = np.argsort(flat, kind="stable")
                run = np.nonzero(np.diff(flat[by], prepend=-1))[0]
                g["embed"][flat[by[run]]] = np.add.reduceat(back.take(by, axis=0), run)
                for k in p:
                    step = g[k] / np.float32(n)
                    past[k] += step * step
                    p[k] -= 0.1 * step / np.sqrt(past[k])

    def packed(self) -> np.ndarray:
        """All parameters and sums of squares as one vector."""
        return np.concatenate([x[k].reshape(-1) for x in (self.p, self.past) for k in self.p]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for x in (self.p, self.past):
            for k in self.p:
                x[k] = flat[at : at + x[k].size].reshape(x[k].shape).astype(np.float32)
                at += x[k].size


def _symbol_counts(counts: DataFrame, symbols: Symbols) -> np.ndarray:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for b in batches:
            total += np.bincount(symbols.of(b.column(0).to_pylist()), b.column(1).to_numpy(), minlength=SIZE).astype(np.int64)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["symbol", "n"])

    corpus = np.ones(SIZE)
    for r in counts.mapInArrow(summed, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # SIZE rows
        corpus[r["symbol"]] += r["n"]
    return corpus


def _trained(rows: DataFrame, start: Network, groups: int, epochs: int, seed: int) -> tuple[int, np.ndarray]:
    """rows: group, s. Each group's documents train a network from start; gives the tokens, and the networks' mean weighted by them, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(flat)), 0
        now, some, held, seen, network = None, [], 0, 0, start

        def flush(end: bool) -> None:
            nonlocal some, held, seen, total, weight
            if held:
                network.fit(some, epochs, seed)
            some, seen, held = [], seen + held, 0
            if end and seen:
                total, weight, seen = total + seen * network.packed(), weight + seen, 0

        for b in batches:
            for group, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if group != now:
                    flush(True)
                    now = group
                    network.unpack(flat)
                some.append(np.frombuffer(s, "<u2").astype(np.int64))
                held += len(some[-1])
                if held >= HELD:
                    flush(False)
        flush(True)
        if weight:
            yield _sum_row(TaskContext.get().partitionId(), weight, total)

    flat = start.packed()
    tasks = min(groups, TASKS)
    rows = rows.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group", F.xxhash64("s"), "s")
    sums = written(rows.select("group", "s").mapInArrow(run, _SUMS), "networks")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartitionById(tasks, "part").sortWithinPartitions("part", "weight", F.xxhash64("total"))
        sums = written(sums.mapInArrow(_added, _SUMS), "networks")
    found = sums.orderBy("part").toArrow()  # at most FAN networks
    weights = found.column(1).to_pylist()
    if not weights:
        return 0, flat
    return sum(weights), sum(np.frombuffer(x, float) for x in found.column(2).to_pylist()) / sum(weights)


_SUMS = "part int, weight long, total binary"


def _sum_row(part: int, weight: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "weight", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the networks of a task, which hold one part."""
    part, weight, total = None, 0, None
    for b in batches:
        for r in b.to_pylist():
            x = np.frombuffer(r["total"], float)
            part, weight, total = r["part"], weight + r["weight"], x if total is None else total + x
    if part is not None:
        yield _sum_row(part, weight, total)


def vocabulary(counts: DataFrame) -> tuple[Symbols, np.ndarray]:
    """The symbols of words, and how often each symbol occurs, plus one."""
    top = [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(SIZE - OTHERS).select("word").collect()]
    symbols = Symbols({w: k for k, w in enumerate(top)})
    return symbols, _symbol_counts(counts, symbols)


def frequent_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, not more than `most`, down to a step of a logarithmic scale; and their counts."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # at most 64 * 16
    within = [k for (k, _), total in zip(sizes, itertools.accumulate(c for _, c in sizes), strict=True) if total <= most]
    if not within:
        return [], np.empty(0)
    found = counts.where(step >= within[-1]).select("word", "n").toArrow()
    return found.column(0).to_pylist(), found.column(1).to_numpy()


def encoded(docs: DataFrame, symbols: Symbols, corpus: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, row (a number of the row's own), s (symbols, two bytes each); and with counts term, the sum of ln p(word | symbol) but for ln n
    of the words in rare, which the executors don't hold."""
    frequent, n_frequent = frequent_words(counts, FREQUENT) if counts is not None else ([], np.empty(0))
    shared = session(docs).sparkContext.broadcast((symbols, frequent, n_frequent))  # bounded: FREQUENT words
    words_apart = counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, frequent, n_frequent = shared.value
        number, row = {w: k for k, w in enumerate(frequent)}, TaskContext.get().partitionId() << 40
        # p(word | symbol) is 1 for a symbol of one word
        log_total = np.where(np.arange(SIZE) < SIZE - OTHERS, 0, np.log(corpus))
        log_n = np.concatenate((np.log(n_frequent), [0]))
        for b in batches:
            n, at, distinct = coded(b.column(1))
            some = distinct.to_pylist()
            symbol = symbols.of(some)
            edge = np.concatenate(([0], np.cumsum(2 * n))).astype(np.int32)
            out = [b.column(0), pa.array(row + np.arange(len(n))), pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge), pa.py_buffer(symbol.astype("<u2").take(at))])]
            row += len(n)
            if words_apart:
                known = np.fromiter((number.get(w, -1) for w in some), np.int64, len(some))
                shares, of = symbol >= SIZE - OTHERS, np.repeat(np.arange(len(n)), n)
                term = np.where(shares, log_n[known] - log_total[symbol], 0)
                left = np.nonzero((shares & (known < 0)).take(at))[0]
                ends = np.concatenate(([0], np.cumsum(np.bincount(of[left], minlength=len(n)))))
                out += [pa.array(np.bincount(of, term.take(at), minlength=len(n)), pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), distinct.take(pa.array(at[left])))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "row", "s", "term", "rare"][: len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, row long, s binary" + (", term double, rare array<binary>" if words_apart else ""))


def fitted(rows: DataFrame, corpus: np.ndarray, seed: int = SEED, group: int = GROUP, passes: tuple[int, ...] = PASSES) -> Network:
    """rows: doc_id, row, s, a written table."""
    network = Network(corpus, seed)
    groups = max(1, -(-int(corpus.sum() - SIZE) // group))
    rows = rows.where("length(s) > 0").select(F.xxhash64(F.lit(seed), "doc_id", "s").alias("mark"), "row", "s")
    # rows that repeat an id and a text are dealt one by one, as a third of all rows may
    again = written(rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("mark").alias("again")), "repeated-rows")
    dealt = F.when(F.col("again").isNull(), F.col("mark")).otherwise(F.xxhash64("mark", "row"))
    rows = rows.join(again, F.col("mark") == F.col("again"), "left").withColumn("mark", dealt)
    rows = rows.select(F.pmod("mark", F.lit(groups)).cast("int").alias("group"), F.pmod(F.xxhash64("mark"), F.lit(SHARES[-1])).cast("int").alias("share"), "s")
    for (lo, hi), epochs in zip(itertools.pairwise(SHARES), passes, strict=True):
        n, flat = _trained(rows.where(F.col("share").between(lo, hi - 1)), network, groups, epochs, seed)
        network.unpack(flat)
        network.tokens += n
    return network


def train(docs: DataFrame, counts: DataFrame | None = None, seed: int = SEED, group: int = GROUP, passes: tuple[int, ...] = PASSES) -> tuple[Symbols, Network]:
    """docs: doc_id, text."""
    symbols, corpus = vocabulary(written(word_counts(docs), "word-counts") if counts is None else counts)
    return symbols, fitted(written(encoded(docs, symbols, corpus), "encoded"), corpus, seed, group, passes)


def _network_scores(rows: DataFrame, network: Network) -> DataFrame:
    """rows (doc_id, row, s, term) with n_words and log_prob instead of s and term."""
    shared = rows.sparkSession.sparkContext.broadcast(network)  # bounded: the network alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        tables = network.tables()
        for b in batches:
            parts = [np.frombuffer(x, "<u2") for x in b.column(2).to_pylist()]
            n = np.array([len(x) for x in parts], np.int64)
            share = np.cumsum(n) // HELD  # as many documents at once as hold HELD tokens, or one
            total = np.concatenate([np.empty(0), *(network.sums([parts[k] for k in np.nonzero(share == at)[0]], tables) for at in np.unique(share))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(total + b.column(3).to_numpy())], ["doc_id", "row", "n_words", "log_prob"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row", "s", "term").mapInArrow(run, f"doc_id {kind}, row long, n_words long, log_prob double")


def scored(docs: DataFrame, model: tuple[Symbols, Network] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob for each row of docs. A model without the counts of its words scores symbols only."""
    session(docs)
    if model is None:
        counts = written(word_counts(docs), "word-counts") if counts is None else counts
        symbols, corpus = vocabulary(counts)
        coded_rows = written(encoded(docs, symbols, corpus, counts), "encoded")
        network = fitted(coded_rows, corpus)
    else:
        symbols, network = model
        coded_rows = encoded(docs, symbols, network.corpus, counts)
        coded_rows = coded_rows.withColumn("term", F.lit(0.0)) if counts is None else written(coded_rows, "encoded")
    rows = _network_scores(coded_rows, network)
    if counts is not None:
        # whole numbers, whose sum doesn't depend on the order
        log_n = F.round(F.ln(F.coalesce("n", F.lit(1))) * (1 << 32)).cast("long")
        more = coded_rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row").agg((F.sum(log_n) / (1 << 32)).alias("more"))
        rows = rows.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "log_prob", (F.col("log_prob") / F.greatest("n_words", F.lit(1))).alias("mean_log_prob"))


def op9_lm(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
