import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in every column, empty and very long texts, equal and repeated rows, columns of clashing names."""
    long = " ".join(f"word{i % 977} wörd{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "same text here, the same again and again " * 5, "en", "a", 205),
        (5, "same text here, the same again and again " * 5, "en", "a", 205),
        (5, "same text here, the same again and again " * 5, "en", "a", 205),
        (6, long, "de", "b", len(long)),
        (7, "<|endoftext|> <|im_start|> 漢字 🙂 İ é   end", None, "b", 30),
        (8, "All rights reserved. Licensed under CC BY 4.0. GNU General Public License", "en", "c", 70),
    ]
    table = spark.createDataFrame(rows, COLUMNS)
    names = ["fp", "rep", "bucket", "name", "at", "low", "high", "state", "ids", "shard", "component", "node", "score", "data", "range_doc", "kept_id", "list", "rows", "a.b", "lang_pred", "n_pii"]
    return table.withColumns({n: F.lit(None).cast("string") for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
