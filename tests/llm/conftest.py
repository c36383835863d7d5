import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows(spark):
    """(doc_id, text, lang, source) of the smallest tables, with null, empty, long, tied and repeated rows."""
    got = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    long_ = " ".join(f"w{i % 701}x{i % 13}" for i in range(6000))
    odd = [(1000, None, "en", "src1"), (1001, "", None, None), (1002, long_, "de", None), (1003, got[0][1], "fr", "src0"), (1004, "a  b \n c\t<|endoftext|>", None, "src1"), (1005, "one two", "en", "src2"), (1006, "ONE two", "en", "src2"), (1007, " \n\t ", "en", "src2"), (None, "null id here", "en", "src2")]
    return got + odd + [got[5], got[5]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names also occur inside operators."""
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, id long, key string")
    df.cache()
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
