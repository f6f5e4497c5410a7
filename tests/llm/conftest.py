import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, key string, label double, stratum string, row long"


@pytest.fixture(scope="session")
def rows():
    """Texts with every awkward case: nulls, empties, ties, repeated rows, copies near and exact, a very long one."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice(["ba", "ti", "on", "er", "lu", "Ke", "zé"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = text(30)
    out = []
    for i in range(60):
        t = text(r.randint(1, 200))
        if i % 7 == 0:
            t += "\n" + shared + " " + text(5)
        if i % 9 == 0:
            t = "\n".join([t, "same line", "same line", "", " ", t[:50]])
        out.append((i, t, ["en", "de", None][i % 3], ["a", "b", "ä", None][i % 4 if i % 2 else 0]))
    out += [(60, None, None, None), (61, "", "en", "a"), (62, " \t\n ", "en", "b"), (63, "one two", "de", "b"), (64, out[5][1], "en", "a"), (65, out[5][1] + " tail", "en", "a"), (5, out[5][1], "en", "a"), (66, text(6000), "en", "c"), (None, "lost words here", "en", "a"), (67, "token = \"" + "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" + "\" end " + text(60), "en", "a")]
    return [(i, t, lang, s, len(t or ""), 7, 8, "k", 0.5, "s", 1) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
