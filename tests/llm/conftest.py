import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts, or from (doc_id, text) and (doc_id, text, lang) rows."""

    def make(rows):
        out = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            out.append((r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")))
        return spark.createDataFrame(out, DOCS)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({n: F.lit("x") for n in ("copy", "line", "node", "key", "ids", "score", "length", "component_id", "kept", "__other", "block", "n", "a", "b")})

    return add
