import random

import pytest

DOCS = "doc_id long, text string, n_words int, score string, kept int, d int, t int, row int, place int, `odd.name` string"


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, equal ids, and columns with names of the operators' own."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(120)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = prose(150)
    texts = [
        (1, prose(40)), (2, None), (3, ""), (4, " \t\n "), (5, "x"), (6, shared), (7, shared), (8, prose(30) + " " + shared + " " + prose(30)),
        (9, "the " * 900), (10, prose(6000)), (None, prose(50)), (None, None), (11, prose(20)), (11, prose(20)),
        (12, "Ünïcode ﬁne 中文 " * 60), (13, shared[:-30] + "another end"), (14, prose(200)), (14, prose(200)),
    ]
    rows = [(i, x, 1, "s", 2, 3, 4, 5, 6, "o") for i, x in texts]
    return rows + [rows[-1], rows[-1], rows[0]]


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(odd_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
