"""Inputs that the tests of this folder share."""

from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """A documents table of (doc_id, text, source) rows; ``extra`` names columns to add."""
    out = spark.createDataFrame(
        [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOC_SCHEMA)
    for name in extra:
        out = out.withColumn(name, F.lit("x"))
    return out.repartition(3)


#: Null ids, texts and sources, empty and blank texts, ties, repeated rows, one long text.
EDGE_ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two three four five", "a"),
    (4, "one two three four five", "a"), (5, "ONE two Three four five", "b"), (None, "no id here", "b"),
    (None, None, None), (7, "one two three four five", "é"), (8, "word " * 5000, "b"),
    (9, "Ünïcode \U0001f600 text with\x1codd\x85spaces <|endoftext|> it's", "a"),
]
CLASHING = ("size", "start", "key", "bits", "ids", "n", "part", "before", "fp", "row", "block", "words", "target")
