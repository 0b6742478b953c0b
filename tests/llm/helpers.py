"""Small tables for the tests of the training-data operators."""

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", first=0):
    """A table of documents; None and repeated texts are allowed."""
    rows = [(first + i, t, lang, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("score", "lang_pred", "fp", "row", "piece", "ident", "_parts", "_at", "component_id", "n_words", "failed", "predicted", "start", "_id", "u", "task")
    return df.select("*", *[F.lit("x").alias(c) for c in names])


def words(n, seed=0, letters="abcdefghijklmnop"):
    """n random words."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n)]
