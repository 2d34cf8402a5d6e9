"""Small tables with the hard cases."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those that operators use themselves.
CLASHES = "class_id long, block int, score double, spans string, kind string, n int, bucket int, keep boolean, label int, row string, name string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    base = " ".join(words(1, 120))
    near = " ".join(words(1, 120)[:-2] + ["other", "end"])
    return [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),  # an exact copy
        (3, near, None, "a", None),  # a near copy
        (4, None, "en", None, None),
        (5, "", "fr", "b", 0),
        (6, "  \n\t ", "fr", "b", 5),
        (7, "one", None, None, 3),
        (8, "One  two", "de", "b", 8),
        (9, " ".join(words(9, 30_000, 5_000)), "es", "a", None),  # a very long text
        (10, "é漢𝄞 mail me a.b@c.de now +1 (988) 555-2485, 10.2.3.4 and 4111 1111 1111 1111", "en", "c", 70),
        (10, "é漢𝄞 mail me a.b@c.de now +1 (988) 555-2485, 10.2.3.4 and 4111 1111 1111 1111", "en", "c", 70),  # a repeated row
        (None, " ".join(words(12, 90)), "en", "c", None),
        (None, " ".join(words(12, 90)), "en", "c", None),
        (13, "x" * 50_000, "en", "a", 50_000),  # one very long word
    ]


def edge_docs(spark):
    rows = [(*r, 5, 6, 0.5, "s", "k", 7, 8, False, 1, "r", "m") for r in edge_rows()]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHES}").repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHES}")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
