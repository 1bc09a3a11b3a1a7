import hashlib
import re

import duckdb

import __spark_entry__
import corpus_pipeline
from clickloom.llm import decontamination, sentencepiece_bpe, toxicity
from tests.conftest import DATA
from tests.llm import helpers
from tests.llm.test_near_dedup import brute
from tests.llm.test_personal_data import spans

SF = f"{DATA}/sf0.01"


def test_stages_do_what_they_say(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall())
    machine = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = sorted(r.doc_id for r in toxicity.scored(docs, machine).where("score < 0.5").collect())
    assert 800 < len(left) < 1000
    left = [left[i] for i, _, _, kept in brute([texts[i] for i in left]) if kept]
    hit = {r.doc_id for r in decontamination.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert hit & set(left)
    left = [i for i in left if i not in hit]
    rows = {r.doc_id: r for r in __spark_entry__.queries()["pipeline"](spark, SF).collect()}
    assert sorted(rows) == left
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    for i in left:
        assert rows[i].n_tokens == len(rows[i].ids) and rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, rows[i].ids)).encode()).hexdigest()
        secret = re.search(r'(?i)token = "[0-9a-f]{40}"', texts[i] or "")
        if not spans(texts[i]) and not secret:
            assert rows[i].ids == library.encode(texts[i])
        else:  # identifiers are masked, discovered secrets too
            decoded = library.decode(rows[i].ids)
            assert not spans(decoded) and not re.search(r'(?i)token = "[0-9a-f]{40}"', decoded)


def test_odd_tables(spark):
    docs = helpers.frame(spark, [None, "", "a", "a", None]).withColumnRenamed("source", "score").selectExpr("*", "1 AS toxic", "lang AS base", "2 AS kept_id", "3 AS more", "4 AS component")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == "sentencepiece"
        docs = out
    assert {(r.doc_id, r.n_tokens) for r in docs.collect()} == {(0, 0), (1, 0), (2, 1), (4, 0)}
    empty = helpers.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
