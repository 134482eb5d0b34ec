import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from (id, text[, lang, source]) rows, with an extra column whose name clashes with those of the operators."""

    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1]) if r[1] is not None else 0) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if not extra:
            return df
        for name in ("row", "score", "block", "part", "bucket", "node", "items", "html", "component_id", "halo", "mix__order", "label", "k1"):
            df = df.selectExpr("*", f"doc_id as `{name}`")
        return df

    return make
