"""Awkward documents that every operator has to take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    prose = " ".join(word[(i * 7 + i // 5) % len(word)] for i in range(90))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, prose, "en", "b", 1),
            (5, prose.upper(), "en", None, 2), (6, prose, None, "b", 1), (7, "x" * 30_000, "en", "c", 3),
            (8, " ".join(f"w{i % 977}" for i in range(20_000)), "en", "c", 4), (9, "É é ß İ   \U0001f600 naïve", "fr", "é", 5),
            (10, "one", "en", "z", 3), (None, "no id", "en", "a", 5), (None, None, None, None, None),
            (11, prose, "en", "b", 1), (11, prose, "en", "b", 1), (12, "don't we'll  go\r\n\r\n42 times\x1c!", "en", "b", 1)]
    return rows + [(100 + i, f"Document {i} " + " ".join(word[(i * j + j) % 19] for j in range(i)), "en", "bcd"[i % 3], i) for i in range(40)]


def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df, *names):
    """The same rows with extra columns of the names that operators give their own columns."""
    return df.withColumns({n: F.lit("clash") for n in names})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
