import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylog.llm import bpe, language, lm, mixing, pii, sharding, simhash, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


# --- personal data -----------------------------------------------------------------------------------------------------------

PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def base(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m[0]))


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(0)
    for n in range(5000):
        text = "".join(rng.choice(list("a.@-+ 0123456789()b"), n % 60))
        assert pii.base_spans(text) == base(text)


def test_pii(docs, texts):
    found = {(r["doc_id"], r["base_sha256"], r["spans"]) for r in pii.spans(docs).collect()}
    assert pii.spans(docs).count() == len(texts)
    for doc_id, text, _ in texts:
        (spans,) = {s for i, h, s in found if i == doc_id and h == hashlib.sha256(pii.listed(base(text)).encode()).hexdigest()}
        assert set(pii.listed(base(text)).split(",")) <= set(spans.split(","))
    assert pii.spans(docs.limit(0)).count() == 0


def test_pii_network():
    p = pii.trained()
    x, y = pii.labelled(300, 99)
    assert (pii.viterbi(pii.emissions(p, x), p["trans"] + pii.allowed()) == y).mean() > 0.95  # held out: another seed
    add = lambda s: pii.listed(pii.find(p, [s])[0][1])
    assert add("so call (414) 555-3519 now") == "phone:8:22"
    assert add('token = "74e9e412cf0507f8a9e05495d0eccfb1407081fe" on 2024-01-02 12:30') == ""
    assert pii.masked("mail a@b.org now", pii.base_spans("mail a@b.org now")) == "mail [EMAIL] now"
    # a window's spans fit together: those of the whole text are found wherever the windows' edges fall
    for shift in range(0, 100, 7):
        text = "word " * 20 + "x" * shift + " (414) 555-3519 " + "word " * 20
        assert pii.listed(pii.find(p, [text])[0][1]) == f"phone:{101 + shift}:{115 + shift}"


def test_posteriors_and_viterbi_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    e, t = rng.standard_normal((2, 4, 3)), rng.standard_normal((3, 3))
    m, pairs = pii.posteriors(e, t)
    paths = list(itertools.product(range(3), repeat=4))
    total = np.zeros((3, 3))
    for n in range(2):
        score = np.array([sum(e[n, k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)) for path in paths])
        w = np.exp(score) / np.exp(score).sum()
        assert tuple(pii.viterbi(e, t)[n]) == paths[int(score.argmax())]
        for k in range(4):
            assert np.allclose(m[n, k], [sum(x for x, path in zip(w, paths, strict=True) if path[k] == y) for y in range(3)])
        for x, path in zip(w, paths, strict=True):
            for a, b in itertools.pairwise(path):
                total[a, b] += x
    assert np.allclose(pairs, total)


# --- token files ---------------------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    manifest = token_files.write(docs, file)
    start, want = 0, []
    for doc_id, text, _ in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    rows = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    uri = manifest.orderBy(F.desc("n_records")).first()["uri"]
    index, records = token_files.read_index(uri), list(token_files.read_file(uri))
    for k in np.random.default_rng(1).permutation(len(index))[:5]:
        doc_id, found = token_files.read_record(uri, index["offset"][k])
        assert doc_id == records[k][0] and (found == records[k][1]).all()
    path = uri.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(token_files.read_file(uri))
    assert token_files.read(token_files.write(docs.limit(0), file)).count() == 0


@pytest.mark.parametrize("text", ["", "don't. I'LL.. x..y,,.z ... ,a A,B. é. É", "a\x1cb\x85c <|endoftext|> <|ENDOFTEXT|> f<|startoftext|>.", "12.5, İSTANBUL İ. 's. ΑΣ. ΑΣ ½.5 ́. ́x"])
def test_words_encode_as_texts(text):
    coder = token_files.WordEncoder(P.path("word_bpe_49k.json"))
    assert next(iter(coder.encode_all([text]))).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


# --- language --------------------------------------------------------------------------------------------------------------------


def test_language(spark, docs, texts):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(full).join(full.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    found = language.identify(docs).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == "und" for r in found) == sum(not any(map(str.isalpha, t)) for _, t, _ in texts) == 3
    for r in found:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert sum(r["doc_id"] is not None and r["doc_id"] < 1000 for r in kept.collect()) == sum(d is not None and d < 1000 for d, _, _ in texts)  # clean ones stay
    assert language.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_counts_of_long_documents(spark):
    """Counts beyond 16 bits reach the centroids whole."""
    texts = ["ab cd " * 70_000, "the cat and the dog " * 20]
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 5][:2]
    docs = spark.createDataFrame(list(zip(ids, texts, ["en", "en"], strict=True)), "doc_id long, text string, lang string")
    found = np.array([language.counts(t) for t in texts], float)
    assert found.max() > 1 << 16
    assert np.allclose(language.train(docs).centroids, language.Centroids(["en", "en"], found).centroids)


# --- mixing and sharding ------------------------------------------------------------------------------------------------------------


def test_mixing(docs, texts):
    size = lambda t: len(WORD.findall(t))
    sums = Counter()
    for _, t, r in texts:
        sums[r["source"]] += size(t)
    order = sorted(sums, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sums.values()), set(order)
    while True:  # reshare until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sums[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sums[s]
            left -= target[s]
        free -= above
    rows = mixing.repetitions(docs).collect()
    assert len(rows) == len(texts)
    got = {r["source"]: r["target"] for r in rows}
    for s in order:
        assert got[s] == pytest.approx(target[s])
    assert all(0 <= r["copies"] <= 2 for r in rows) and sorted(r["size"] for r in rows) == sorted(size(t) for _, t, _ in texts)
    again = mixing.mix(docs)
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in rows) == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sharding(docs, texts):
    rows = sharding.assign(docs).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t, _ in texts)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows) and len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    assert sharding.assign(docs.limit(0)).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r["shard"]: r["count"] for r in sharding.assign(ids, [3.0, 1.0]).groupBy("shard").count().collect()}
    assert counts[0] / counts[1] == pytest.approx(3, rel=0.1)


# --- near-duplicates ----------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(d, f"{fp:016x}", least.get(find(k))) for k, (d, fp) in enumerate(prints)]


def test_simhash(docs, texts):
    same(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"), brute_components([(d, brute_fingerprint(t)) for d, t, _ in texts]))
    kept = simhash.deduplicated(docs)
    # one row of each component; components of different texts may share a smallest id
    prints = [(d, brute_fingerprint(t)) for d, t, _ in texts]
    order = sorted(range(len(prints)), key=lambda k: prints[k][1])
    roots = brute_components([(n, prints[k][1]) for n, k in enumerate(order)])
    least = {}
    for k, (_, _, root) in zip(order, roots, strict=True):
        least[root] = min([x for x in (least.get(root), prints[k][0]) if x is not None], default=None)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(c or -1 for c in least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [16, 8192])
def test_links_in_hot_buckets(spark, tile):
    """Fingerprints of which most share their high bits, with buckets of many tiles and of one."""
    rng = np.random.default_rng(3)
    prints = [int(x) & 0xFFFF | 0x5A5A_0000_1234_0000 for x in rng.integers(0, 1 << 16, 150)] + [int(x) for x in rng.integers(0, 1 << 63, 50)]
    rows = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(prints)]
    found = simhash.classes(spark.createDataFrame(rows, "doc_id long, _fp long"), tile=tile)
    got = {r["_fp"]: r["component_id"] for r in found.collect()}
    assert [got[fp] for _, fp in rows] == [c for _, _, c in brute_components(list(enumerate(prints)))]


def test_more_parts_lose_no_pair():
    for n in (10, 10**8, 10**10):
        parts = simhash.parts_for(n)
        masks = simhash._masks(parts, 4)
        rng = np.random.default_rng(2)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & m == 0 for m in masks)


# --- BPE -----------------------------------------------------------------------------------------------------------------------------


def test_bpe(spark, docs, texts):
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    want, ids = [], []
    for doc_id, text, _ in texts:
        found = t.encode(text, add_special_tokens=False).ids
        ids.append((doc_id, found))
        want.append((doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(t.decode(found, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.digests(docs, file), want)
    tokens = bpe.token_ids(docs, file)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in tokens.collect()) == sorted((d or -1, i) for d, i in ids)
    same(bpe.decoded(tokens, file), [(d, t) for d, t, _ in texts])
    assert bpe.digests(docs.limit(0), file).count() == 0


def test_words_of_bpe_encode_as_texts():
    file = P.path("byte_bpe_50k.json")
    t, special = bpe.tokenizer(file), bpe.specials(file)
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "a", "B", "1", ".", "'s", "\t", "é", "　", "漢", "<|endoftext|>", "\x1c", "\x85", "​"]
    for n in range(2000):
        text = "".join(rng.choice(parts, n % 15))
        words = bpe.split(text, special)
        assert "".join(words) == text and [i for w in words for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


# --- language model --------------------------------------------------------------------------------------------------------------------


def test_lm(docs, texts):
    symbols, network = lm.train(docs)
    counts = Counter(w for _, t, _ in texts for w in lm.words(t))
    top = [w for w, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[: lm.SIZE - lm.OTHERS]]
    assert list(symbols) == top
    rows = lm.scored(docs, (symbols, network)).collect()
    tables = network.tables()
    want = [(d, len(lm.words(t)), network.log_probs([symbols.of(lm.words(t))], tables).sum()) for d, t, _ in texts]
    for got, exp in zip(sorted(rows, key=lambda r: key((r["doc_id"], r["n_words"]))), sorted(want, key=lambda r: key((r[0], r[1]))), strict=True):
        assert (got["doc_id"], got["n_words"]) == exp[:2] and got["log_prob"] == pytest.approx(exp[2], rel=1e-5)
    assert lm.scored(docs.limit(0)).count() == 0


def test_lm_probabilities_sum_to_one_and_beat_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    symbols, network = lm.train(docs)
    s = symbols.of(lm.words(docs.first()["text"]))
    tables, around = network.tables(), s[:5].copy()
    total = 0.0
    for y in range(lm.SIZE):
        around[2] = y
        total += np.exp(network.log_probs([around], tables)[2])
    assert total == pytest.approx(1, rel=1e-3)
    parts = [symbols.of(lm.words(r["text"] or "")) for r in docs.collect()]
    assert network.log_probs(parts, tables).mean() > network.log_corpus[np.concatenate(parts)].mean()


def test_lm_trains_on_every_document(spark):
    """A pattern that only documents outside of any sample by the least hashes hold is learned, whatever the partitions."""
    rng = np.random.default_rng(6)
    outside = {r["id"] for r in spark.range(3000).where(F.pmod(F.xxhash64(F.lit(lm.SEED), "id"), F.lit(3000)) >= 800).where("id % 40 = 0").collect()}
    texts = ["ping pong " * 20 if k in outside else " ".join(f"w{x}" for x in rng.integers(0, 50, 40)) for k in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    (symbols, network), (_, again) = (lm.train(docs.repartition(n), group=20_000) for n in (3, 5))
    assert network.tokens == 3000 * 40
    part = symbols.of(lm.words("ping pong " * 20))
    found = network.log_probs([part], network.tables())
    assert found[2:-2].mean() > network.log_corpus[part].mean() + 2
    assert again.log_probs([part], again.tables()) == pytest.approx(found, rel=1e-4)


@pytest.mark.parametrize("frequent", [0, 900, 1 << 17])
def test_lm_tells_words_of_a_symbol_apart(spark, docs, texts, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    counts = Counter(w for _, t, _ in texts for w in lm.words(t))
    table = lm.word_counts(docs).cache()
    symbols, network = lm.train(docs, table)
    total = Counter()
    for w, n in counts.items():
        total[symbols.of([w])[0]] += n
    assert len(counts) > 2 * lm.SIZE

    def log_prob(t):
        ws = lm.words(t)
        apart = sum(np.log(max(1, counts[w]) / (total[symbols.of([w])[0]] + 1)) for w in ws if w not in symbols)
        return network.log_probs([symbols.of(ws)], network.tables()).sum() + apart

    other = [(-5, "words never seen: qqqxyzzy qqqyyzzy"), (-6, "")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(other, "doc_id long, text string"))
    want = [(d, len(lm.words(t)), log_prob(t)) for d, t, *_ in [*texts, *other]]
    for got, exp in zip(sorted(lm.scored(more, (symbols, network), table).collect(), key=lambda r: key(r[:2]) + (r[2],)), sorted(want, key=lambda r: key(r[:2]) + (r[2],)), strict=True):
        assert (got["doc_id"], got["n_words"]) == exp[:2] and got["log_prob"] == pytest.approx(exp[2], rel=1e-5)
    assert got["mean_log_prob"] == got["log_prob"] / got["n_words"]


def test_lm_deals_repeated_rows_over_groups(spark):
    """A third of all rows are one row: no group holds them all."""
    rng = np.random.default_rng(3)
    texts = [(None, "same words here " * 20)] * 300 + [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 60))) for k in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = []
    fit = lm._trained

    def trained(rows, start, groups, *rest):
        sizes.append([r["count"] for r in rows.groupBy("group").count().collect()])
        return fit(rows, start, groups, *rest)

    try:
        lm._trained = trained
        _, network = lm.train(docs, group=5_000)
    finally:
        lm._trained = fit
    assert network.tokens == 900 * 60
    assert max(map(max, sizes)) < 90


def test_lm_has_one_schedule_for_all_sizes(spark, monkeypatch):
    """One group of documents or several: the same documents in the same order of ranges, with the same passes."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 50))) for k in range(400)], "doc_id long, text string")
    fit, calls = lm._trained, {}

    def trained(rows, start, groups, epochs, seed):
        calls.setdefault(groups, []).append((epochs, sorted(r["s"] for r in rows.select("s").collect())))
        return fit(rows, start, groups, epochs, seed)

    monkeypatch.setattr(lm, "_trained", trained)
    networks = [lm.train(docs, group=group)[1] for group in (20_000, 19_999, 5_000)]
    assert sorted(calls) == [1, 2, 4] and calls[1] == calls[2] == calls[4]
    assert [epochs for epochs, _ in calls[1]] == list(lm.PASSES) and sum(len(some) for _, some in calls[1]) == 400
    assert all(network.tokens == 400 * 50 for network in networks)


def test_lm_equals_a_plain_computation(spark):
    rng = np.random.default_rng(8)
    texts = ["", "one", *(" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "zyx", "qrs"], n)) for n in (2, 3, 5, 40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = lm.word_counts(docs)
    symbols, network = lm.train(docs, table)
    p, counts = network.p, Counter(w for t in texts for w in lm.words(t))
    total = np.ones(lm.SIZE)
    for w, n in counts.items():
        total[symbols.of([w])[0]] += n

    def token(s, k):
        around = [s[k + d] if 0 <= k + d < len(s) else lm.PAD for d in range(-lm.WIDTH, lm.WIDTH + 1) if d]
        h = np.tanh(sum(p["embed"][c].astype(float) @ p["first"][d] for d, c in enumerate(around)) + p["bias"])
        cls, member = divmod(int(s[k]), lm.MEMBERS)
        a, b = np.exp(h @ p["cls"] + p["cls_bias"]), np.exp(h @ p["member"][cls] + p["member_bias"][cls])
        return np.log(lm.MIX * a[cls] / a.sum() * b[member] / b.sum() + (1 - lm.MIX) * total[s[k]] / total.sum())

    found = {r["doc_id"]: r["log_prob"] for r in lm.scored(docs, (symbols, network), table).collect()}
    for doc_id, t in enumerate(texts):
        s = symbols.of(lm.words(t))
        apart = sum(np.log(counts[w] / total[symbols.of([w])[0]]) for w in lm.words(t) if w not in symbols)
        assert found[doc_id] == pytest.approx(sum(token(s, k) for k in range(len(s))) + apart, rel=1e-4, abs=1e-6)


# --- personal data: long texts and long spans ------------------------------------------------------------------------------------------


def test_pii_long_runs_of_digits(spark):
    runs = ["0" * 5000 + ".1.2.3", "9" * 5000 + ".1.2.3", "1." * 5000, "7" * 100_000, "+" + "1 " * 5000, "@" * 5000, "1@" * 5000]
    for text in runs[1:]:
        assert pii.base_spans(text) == ([] if len(text) > 10_000 or text[0] == "9" else base(text))
    assert pii.listed(pii.base_spans(runs[0])) == "ip:0:5006"
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(runs)], "doc_id long, text string")
    assert pii.spans(docs).count() == len(runs)
    assert pii.redacted(docs).where("doc_id = 0").first()["text"] == "[IP]"


@pytest.mark.parametrize("length", [49, 76, 140, 400])
def test_pii_finds_spans_longer_than_a_stride(length):
    rng = np.random.default_rng(length)
    word = lambda n: "".join(rng.choice(list("etaoinshrdlucmfpg"), n))
    found = []
    for shift in range(0, 2 * pii.STRIDE, 4):
        user = (length - 7) // 2
        address = f"{word(user)} @ {word(length - user - 7)}.com"
        text = "word " * 13 + "x" * shift + " " + address + " " + "so it goes " * 12
        at = 66 + shift
        found.append(f"email:{at}:{at + length}" in pii.listed(pii.find(pii.trained(), [text])[0][1]).split(","))
    assert np.mean(found) >= 0.9


def test_reconciled_equals_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    text = "415 555 2671 " * 8
    for _ in range(200):
        spans = []
        for _ in range(7):
            a = 13 * int(rng.integers(0, 7))
            spans.append((a, 3, a + int(rng.choice([12, 12, 25])), float(rng.choice([0.5, 0.91, 0.95, 0.99]))))
        base_ = [(13 * int(rng.integers(0, 8)), 2, 13 * 8)] if rng.random() < 0.3 else []
        good = {}
        for a, k, b, w in spans:
            if w >= pii.SURE and pii.well_formed(text, (a, k, b)) and not any(a < y and x < b for x, _, y in base_):
                good[a, k, b] = max(w, good.get((a, k, b), 0))
        best = 0.0
        for n in range(len(good) + 1):
            for some in itertools.combinations(good, n):
                if all(x[2] <= y[0] or y[2] <= x[0] for x, y in itertools.combinations(some, 2)):
                    best = max(best, sum(good[s] * (s[2] - s[0]) for s in some))
        got = pii.reconciled(text, base_, spans)
        added = [s for s in got if s not in base_]
        assert all(x[2] <= y[0] for x, y in itertools.pairwise(added)) and set(added) <= set(good) and set(base_) <= set(got)
        assert sum(good[s] * (s[2] - s[0]) for s in added) == pytest.approx(best)


def test_pii_reading_again_ends():
    """Spans that new windows cut at their own edges aren't read again for themselves."""
    rng = np.random.default_rng(11)
    text = "".join(rng.choice(list("0123456789 .-()+@ab"), 30_000))
    assert pii.find(pii.trained(), [text])[0][0] == pii.base_spans(text)
    text = " ".join(pii._positive(rng, int(k), 12) for k in rng.integers(0, 4, 800))
    (found, every), = pii.find(pii.trained(), [text])
    assert set(found) <= set(every)


# --- repeated rows and ids -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_equals_the_tokenizer(file, texts):
    coder = token_files.WordEncoder(P.path(file))
    assert coder.by_words == (file == "word_bpe_49k.json")
    some = [t or "" for _, t, _ in texts][:60] + ["Hello  World, it's 東京. é \n\tEnd...", " a ", "<|startoftext|> B"]
    some = [t for t in some if len(t) < 20_000]
    assert [x.tolist() for x in coder.encode_all(some)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_mixing_draws_repeated_ids_one_by_one(spark):
    """A third of all rows share an id and a text, a third have no id: what is taken of each source is near its target."""
    rows = [(1, "same words here", "a")] * 2000 + [(None, f"text number {k}", "b") for k in range(2000)] + [(10 + k, "some other text", "c") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    found = mixing.repetitions(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    for r in found:
        assert abs(r["taken"] - r["target"]) < 0.1 * r["size"]
    assert sorted(mixing.mix(docs).collect(), key=str) == sorted(mixing.mix(docs).collect(), key=str)


def test_mixing_of_empty_texts(spark):
    docs = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate([("", "a"), (None, "a"), (" \t", None)])], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"], r["target"], r["copies"]) for r in mixing.repetitions(docs).collect()} == {(0, 0, 0.0, 0), (1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mixing.mix(docs).count() == 0


def test_language_sample_is_bounded(spark):
    """Two ids hold a third of all rows each, one of them with one text: the sample is of distinct documents, and bounded."""
    a, b = [k for k in range(9) if zlib.crc32(str(k).encode()) % 5][:2]
    rows = [(a, "the cat sat on the mat", "en")] * 400 + [(b, f"un chat numero {k} dort", "fr") for k in range(400)] + [(10 + k, f"der hund {k} bellt laut", "de") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    taken = []
    plain = language.Centroids.__init__

    def init(self, labels, found, *rest):
        taken.append(Counter(labels))
        plain(self, labels, found, *rest)

    try:
        language.Centroids.__init__ = init
        model = language.train(docs, per_language=30)
    finally:
        language.Centroids.__init__ = plain
    assert taken[0]["fr"] == 30 and 20 <= taken[0]["de"] <= 30 and taken[0].get("en", 1) == 1
    assert [model.predict(t)[0] for t in ("der hund bellt", "le chat dort")] == ["de", "fr"]


def test_language_equals_a_plain_computation(spark):
    rng = np.random.default_rng(1)
    vocabulary = {"x": ["der", "hund", "bellt", "laut", "und"], "y": ["the", "cat", "sat", "on", "mat"]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang], 30)), lang) for k in range(120) for lang in [("x", "y")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    learned = [(t, lang) for k, t, lang in rows if zlib.crc32(str(k).encode()) % 5]

    def grams(text):
        letters = bytes(c if c >= 128 or chr(c).isalpha() else 0 for c in text.lower().encode())
        joined = b"\0" + re.sub(rb"\0+", b"\0", letters.strip(b"\0")) + b"\0"
        out = Counter()
        for n in (2, 3, 4):
            for at in range(len(joined) - n + 1):
                value = 0
                for byte in joined[at : at + n]:
                    value = (value * 257 + byte) % 2**32
                value = (value * 2654435761 + n) % 2**32
                out[((value ^ value >> 15) * 2246822519 % 2**32) >> 20] += 1
        return out

    found = [(grams(t), lang) for t, lang in learned]
    idf = {d: np.log((1 + len(found)) / (1 + sum(d in g for g, _ in found))) + 1 for d in range(language.DIMS)}
    assert model.idf == pytest.approx([idf[d] for d in range(language.DIMS)])

    def unit(g):
        v = np.array([np.log1p(g.get(d, 0)) * idf[d] for d in range(language.DIMS)])
        return v / max(np.linalg.norm(v), 1e-12)

    # each centroid is the direction of the mean of the vectors of its language that are nearest to it
    vectors = [(unit(g), lang) for g, lang in found]
    centers = [(c, model.languages[k]) for c, k in zip(model.centroids, model.of, strict=True)]
    for n, (c, lang) in enumerate(centers):
        mine = [m for m, (_, x) in enumerate(centers) if x == lang]
        near = [v for v, x in vectors if x == lang and mine[int(np.argmax([v @ centers[m][0] for m in mine]))] == n]
        assert near and c == pytest.approx(np.sum(near, 0) / np.linalg.norm(np.sum(near, 0)), abs=1e-5)
    for text in ("the cat und der", "hund", "sat on the mat laut", "q", "1 2", ""):
        cosines = [unit(grams(text)) @ c for c, _ in centers]
        best = int(np.argmax(cosines))
        lang, score, rejected = model.predict(text)
        if not any(map(str.isalpha, text)):
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        eased = min(1.0, (max(1, sum(grams(text).values())) / language.ENOUGH) ** 0.5)
        assert lang == centers[best][1] and score == pytest.approx(max(0, cosines[best]), abs=1e-5) and rejected == (cosines[best] < model.least[best] * eased)


def test_sharding_equals_a_plain_computation(docs, spark):
    from decimal import Decimal, getcontext

    getcontext().prec = 40
    keys = [r["key"] for r in docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")).distinct().collect()]
    weights = [1.0, 2.5, 0.5, 1.0]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    hashes = df.select("key", F.array(*(F.xxhash64(F.lit(11), F.col("key"), F.lit(k)) for k in range(5))).alias("h"), sharding.shard_of(F.col("key"), weights).alias("shard"), sharding.shard_of(F.col("key"), [*weights, 1.0]).alias("grown"))
    for r in hashes.collect():
        scores = [-((Decimal((h % 2**64) >> 11) + Decimal("0.5")) / Decimal(2**53)).ln() / Decimal(w) for h, w in zip(r["h"], [*weights, 1.0], strict=True)]
        assert r["shard"] == min(range(4), key=scores.__getitem__)
        assert r["grown"] == min(range(5), key=scores.__getitem__) and r["grown"] in (r["shard"], 4)
