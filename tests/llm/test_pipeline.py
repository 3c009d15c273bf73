import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from quarrylog.llm import bpe, language, mixing, pii, simhash
from tests.llm.test_text_operators import WORD, brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = [r.asDict() for r in docs.collect() if not model.predict(r["text"] or "")[2]]
    comp = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in rows])
    rows = [r for r, (doc_id, _, least) in zip(rows, comp, strict=True) if doc_id == least]
    for r, (_, every) in zip(rows, pii.find(pii.trained(), [r["text"] for r in rows]), strict=True):
        r["text"] = pii.masked(r["text"], every)
    sums = {}
    for r in rows:
        sums[r["source"]] = sums.get(r["source"], 0) + len(WORD.findall(r["text"]))
    targets = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sums.items()), "source string, size long")).collect()}
    t, want = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in rows:
        rate = targets[r["source"]] / sums[r["source"]]
        u = int(hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        ids = t.encode(r["text"], add_special_tokens=False).ids
        want += [(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] * (int(rate) + (u < rate % 1))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_stages_keep_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    masked = corpus_pipeline.stage_pii(spark, docs, SF).where(F.col("doc_id") == 1004).first()
    assert "[EMAIL]" in masked["text"] and masked["n_chars"] == len(masked["text"])


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert language.accepted(docs).count() == docs.count()  # all are in the four languages
    assert simhash.deduplicated(docs).select("doc_id").distinct().count() == simhash.near_duplicates(docs).select("component_id").distinct().count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mix", "tokens"]
