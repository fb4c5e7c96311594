from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from texts or (id, text) pairs, with the other columns of the table."""
    def make(rows) -> DataFrame:
        full = [(*(r if isinstance(r, tuple) else (k, r)),) for k, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in full], DOCS)
    return make


@pytest.fixture
def odd_docs(spark, docs_of) -> DataFrame:
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "   "), (4, "a"), (5, long), (6, long + " end"), (None, "null id text here now"), (7, "x" * 5_000),
            (8, "same text of several words here"), (9, "same text of several words here"), (9, "same text of several words here"), (10, "é ü ñ 漢字 🙂")]
    df = docs_of(rows)
    for c in ("row", "key", "score", "digest", "bands", "spans", "ids", "id", "n_words"):
        df = df.selectExpr("*", f"'mine' AS {c}")
    return df.selectExpr("* EXCEPT (lang, source)", "CASE WHEN doc_id > 3 THEN 'en' END AS lang", "CASE WHEN doc_id > 4 THEN 'src0' END AS source")
