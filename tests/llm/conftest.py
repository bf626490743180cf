import pytest
from llm_cases import prose
from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


@pytest.fixture
def docs(spark):
    def make(rows):
        full = [(*r, *(None, None, None))[:5] if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Nulls, empty, blank and very long texts, ties and repeated rows.
@pytest.fixture
def odd(docs):
    lines = "\n".join(prose(k, 12) for k in range(6))
    return docs(
        [
            (None, None),
            (1, None, "en", "a", 0),
            (2, "", None, None, 0),
            (3, " \n\t\n ", "en", "a", 5),
            (4, lines, "en", "a", 1),
            (4, lines, "en", "a", 1),
            (5, lines, "en", None, 1),
            (6, prose(1, 40_000), "en", "b", 1),
            (None, lines + "\nend", None, "b", 1),
            (7, "only three words", "en", "b", 1),
        ]
    )
