import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wortlaut.session import local_session  # noqa: E402
from wortlaut.sources.documents import docs_from_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from {path: text or bytes}, in the given order."""
    from pyspark.sql import functions as F

    def make(files: dict):
        rows = [(i, p, bytearray(c if isinstance(c, bytes) else c.encode())) for i, (p, c) in enumerate(files.items())]
        table = spark.createDataFrame(rows, "ord long, path string, content binary")
        return docs_from_table(table, F.col("path"), F.col("content"), F.col("ord"))

    return make


@pytest.fixture(scope="session")
def make_corpus(make_docs):
    from wortlaut.operators.corpus import Corpus

    return lambda files: Corpus.of(make_docs(files))
