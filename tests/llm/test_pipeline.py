"""The pipeline's stages on a small corpus with nulls, copies, repeated rows and clashing column names."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from reelframe.llm import bpe

from . import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250")
    extra = [(None, "some words without any number here", None, None, None), (5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "123 456", "en", "s", 7), (5003, "Mail to joe@x.org and 4111 1111 1111 1111 now", "en", "s", 3)]
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame(extra, docs.schema))
    for name in ("same", "lang_pred", "n_hit", "email"):
        docs = docs.withColumn(name, F.lit(1))
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        rows = kept[name] = docs.collect()
        ids = {r.doc_id for r in rows}
        if name != "bpe":
            assert docs.columns == columns
        if name == "language":
            assert {r.doc_id for r in before} - ids == {5000, 5001, 5002} and len(rows) == len(before) - 3
        if name == "dedup":
            want = brute.near_texts([(r.doc_id, r.text) for r in {r.doc_id: r for r in before if r.doc_id is not None}.values()], 5)
            assert ids == {d for d, (_, c) in want.items() if d == c} | {None} and len(rows) == len(ids)
        if name == "decontaminate":
            want = brute.contaminated([(r.doc_id, r.text) for r in before], items)
            assert ids == {d for d, (_, n, _) in want.items() if not n}
        if name == "pii":
            texts = {r.doc_id: r.text for r in before}
            assert all(not any(brute.private(r.text).values()) and r.n_chars == len(r.text) for r in rows if r.doc_id and any(brute.private(texts[r.doc_id]).values()))
            assert {r.doc_id: r.text for r in rows}[5003] == "Mail to [EMAIL] and [CARD] now"
            assert [r.text for r in rows if r.doc_id == 0] == [texts[0]]
        if name == "bpe":
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(bpe.vocabulary())
            texts = {r.doc_id: r.text for r in before}
            assert all(r.ids == " ".join(map(str, library.encode(texts[r.doc_id], add_special_tokens=False).ids)) for r in rows)
        assert k < 5 and re.fullmatch(r"\w+", name)
