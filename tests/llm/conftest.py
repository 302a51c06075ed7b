import pytest

from partweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, memory="6g", shuffle_partitions=4)


#: Nulls, empty and blank texts, ties, repeats, a very long text and columns whose names clash with the operators'.
@pytest.fixture(scope="session")
def odd_documents(spark):
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    rows = [(1, None, None), (2, "", ""), (3, "   \n\t ", "a"), (4, "one", "a"), (5, "one", "a"), (6, long, "a"),
            (7, long, None), (8, "Ünïcode tëxt with ä few wörds and 𝒳", "b"), (9, "token = 0123456789abcdef0123456789", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return frame.selectExpr("doc_id", "text", "source", "'x' as key", "1 as label", "'y' as spans", "2 as n_words", "'en' as lang")
