"""Tables for the tests of the llm subpackage."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators' own results use.
CLASHING = ["score", "piece", "start", "length", "keep_id", "kept", "node", "low", "keys", "sig", "z", "row", "pos", "range", "tail", "held_out", "label", "shard", "digest", "block", "root", "class_id", "removed"]


def table(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, g, None, None if t is None else len(t)) for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def odd_texts():
    """Null, empty, blank, one letter, marks, very long, repeated, other scripts."""
    long = " ".join(f"word{i % 977} of line {i}" + ("\n" if i % 12 == 0 else "") for i in range(60_000))
    return [None, "", " \t\n ", "a", "!!! ... 123", "\n\n\n", long, long, "même été", "日本語の文章です", "tiny text", "tiny text", "\U0001f600 smile \u0000 null", "x" * 5000]
