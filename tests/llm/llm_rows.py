"""Small tables that hold the awkward cases every operator must stand."""

from pyspark.sql import functions as F

LONG = "the quick brown fox of the old town ran on and on. " * 4000

DOCS = [
    (1, "One two three four five six seven eight nine ten.", "en", "a", 1),
    (1, "One two three four five six seven eight nine ten.", "en", "a", 1),
    (2, "one TWO three four five six seven eight nine ten.", "en", "b", 2),
    (3, None, None, None, None),
    (None, "A text without an id", None, "c", None),
    (4, "", "en", "a", 0),
    (5, " \t\r\n ", "en", "", 5),
    (6, LONG, "en", "d", len(LONG)),
    (7, "a  b \n\n c  d e <|endoftext|> \x00 \x1c z", "en", "e", 9),
    (8, "ж" * 70_000, "ru", "f", 70_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use for columns of their own.
CLASHES = ("row", "words", "id", "ids", "print", "line", "n_words", "kept", "__id", "key", "n")


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    return df.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHES if name not in df.columns])
