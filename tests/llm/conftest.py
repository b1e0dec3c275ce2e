import pytest

from tabscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", partitions=2)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with null ids and texts, extra columns with names the operators use inside."""
    def make(rows, schema="doc_id bigint, text string"):
        extra = ("key string", "row bigint", "print bigint", "_row string")
        filled = [(*r, "x", 1, 2, "y") for r in rows]
        return spark.createDataFrame(filled, ", ".join((schema, *extra)))
    return make
