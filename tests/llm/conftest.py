import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_texts import ODD_TEXTS, prose  # noqa: E402

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *(T.StructField(name, T.StringType()) for name in ("site", "lines", "row", "group", "ids", "rank", "part", "score", "copy", "spans")),
    ]
)
CLASHES = tuple("site lines row group ids rank part score copy spans".split())


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) with extra columns whose names clash."""

    def make(rows, partitions=2):
        full = [(i, t, "en", s, None if t is None else len(t), *CLASHES) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    rows = [(i, t, None if i % 4 == 0 else "site") for i, t in enumerate(ODD_TEXTS)]
    return make_docs([*rows, (3, "one", "site"), (None, prose(3, 50), None), (None, None, None)])
