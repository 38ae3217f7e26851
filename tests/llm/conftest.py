import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHING = ["size", "source_size", "target", "copies", "text_key", "row", "node", "id", "_id", "_u", "_text", "_log_weight", "_likely", "_key", "_row", "_n", "label", "bucket", "base", "extra", "spans", "h", "key", "k", "p", "m", "e", "t", "b", "next_text", "root", "listed", "host", "_neardup_key", "_live"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{i % 977} of{i % 61}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, and runs on.\nA second line of it.", "en", "a", 80),
    (2, "The quick brown fox jumps over the lazy dog, and runs on.\nA second line of it.", "en", "b", 80),
    (2, "The quick brown fox jumps over the lazy dog, and runs on.\nA second line of it.", "en", "b", 80),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (None, "An unnamed text with password=abcdefgh12345 in it.", "en", None, 50),
    (None, None, None, None, None),
    (5, "   \n\t \n\n", "de", "a", 8),
    (6, "é" * 7 + "漢字  🙂 x", "fr", "c", 14),
    (7, "short", "en", "c", 5),
    (8, LONG, "en", "a", len(LONG)),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(TEXTS, DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """Writes tables into a folder of their own: sf(documents=df, ...)."""

    def put(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return put
