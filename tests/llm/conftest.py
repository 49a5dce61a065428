import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) rows, with a column whose name clashes with results' columns."""
    def make(rows):
        from pyspark.sql import functions as F
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return (spark.createDataFrame(full, TEXTS).withColumn("score", F.lit("x"))
                .withColumn("shard", F.lit("y")).withColumn("fp", F.lit("z")))
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated, equal, and one very long text; a null id."""
    long = " ".join(f"word{i % 977} tail{i % 13}," for i in range(30_000))
    base = [(1, "The cat sat on the mat. It was happy."), (2, "The cat sat on the mat. It was happy."),
            (2, "The cat sat on the mat. It was happy."), (3, None), (4, ""), (5, " \n\t "), (6, long),
            (7, "x"), (8, "Ünïcode ß 日本 😀 don't <|endoftext|> 12.5%"), (None, "no id here"), (9, "a\x1cb c")]
    return base + [(100 + i, f"document number {i} has its own few words {i * i} end") for i in range(40)]
