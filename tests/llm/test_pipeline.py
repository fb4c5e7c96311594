from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tidemark.llm.queries import public_ranks


def test_pipeline_removes_what_it_should_and_nothing_else(spark, docs_of, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    clean = {k: " ".join(word() for _ in range(60)) for k in range(400)}
    toxic = {k: " ".join([*(word() for _ in range(30)), "vileword", *(word() for _ in range(20))]) for k in range(1000, 1060)}
    passage = " ".join(word() for _ in range(14))
    leaked = {k: f"{clean[k % 400]} extra{k} {passage.upper()}, more" for k in range(2000, 2010)}
    copies = {3000 + k: clean[k].replace(" ", " \n ") for k in range(50)}
    near = {4000 + k: clean[k + 100].replace(" ", f" new{k} ", 1) for k in range(50)}
    rows = [*clean.items(), *toxic.items(), *leaked.items(), *copies.items(), *near.items(), (5000, None), (5001, ""), (5002, clean[0]), (5002, clean[0])]
    rng.shuffle(rows)
    docs_of(rows).selectExpr("*", "1 AS score", "'x' AS row").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 0) for k in clean] + [(k, 1) for k in toxic]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*clean, 5000}
    ranks = public_ranks()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    for k, r in got.items():
        ids = enc.encode_ordinary(clean.get(k, ""))
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark, odd_docs, tmp_path):
    spark.createDataFrame([(5, 1)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, odd_docs, str(tmp_path))
        assert got.schema == odd_docs.schema and got.count() > 0
        assert step(spark, odd_docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, str(tmp_path)).count() == odd_docs.count()
