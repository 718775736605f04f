import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "alpha beta gamma delta " * 9000
    return [
        (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, None, None), (None, "no id here", "en", "a", 1, "y", 2), (3, "same text  here", "en", "b", 1, "x", 1),
        (4, "same text\there", "de", "b", 1, "x", 1), (4, "same text\there", "de", "b", 1, "x", 1), (5, long, "en", None, 1, "x", 1), (6, long, "fr", "c", 1, "x", 1), (7, " \t\n", "fr", "c", 1, "x", 1),
        (8, "Ünïcode ﬁne <|endoftext|> ſtraße İ 漢字", "de", "c", 1, "x", 1), (9, "1234567890" * 3000, None, "c", 1, "x", 1), (10, "same text here", "en", "b", 1, "x", 1),
    ]


@pytest.fixture(scope="session")
def odd_dir(spark, odd_rows, tmp_path_factory):
    """A folder with the tables that the queries read, the documents being odd_rows."""
    d = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (5, 1, 1), (None, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>open <b>bold &amp; more"), (4, "u", "no tags at all")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)
