import pytest

from chartloom.llm.common import reachable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session", autouse=True)
def workers(spark, tmp_path_factory):
    """Workers can import the package, and intermediate tables go to a folder of the test run."""
    reachable(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with the other columns filled."""

    def build(rows, parts=2):
        full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


#: Nulls, empty and blank texts, repeated rows, odd characters, one long text.
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (None, "a row without id"), (6, "same words here again and again"),
    (6, "same words here again and again"), (7, "Ünïcödé ＷＩＤＥ space x 👍🏽 ñandú's <|endoftext|> end"),
    (8, "word " * 30000), (9, "a\nb\nc\na\nb\nc\n"), (10, "\r\n\x0b\x1c mixed   breaks"),
]
