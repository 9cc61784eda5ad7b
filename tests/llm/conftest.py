import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DATA = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node long, rank int, md5 string, at int, "
          "spans string, _doc string, _text string, ids array<int>")

WORDS = "der Hund the cat runs over la casa de und bellt at night mail to me again now".split()


def long_text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k + k // 5) % len(WORDS)] + str(k * seed % 89) for k in range(n))


def odd_rows() -> list[tuple]:
    """Documents with nulls, empty and long texts, ties, repeated rows, blank lines and shared passages."""
    shared = "first shared line here\nsecond shared line here\n\nthird shared line here\nfourth one"
    twin = long_text(3, 120)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, twin), (7, twin), (8, twin + " extra"),
        (8, twin + " extra"), (9, "intro\n" + shared), (10, shared + "\noutro"), (10, "other text of the same id"),
        (None, twin), (None, shared), (11, long_text(5, 4000)), (12, "x" * 3000), (13, "a b " * 300),
        (14, "write me@example.com or +1 (523) 555-1055 from 10.0.0.1, 4111 1111 1111 1111"), (15, "é中🙂 ñ " * 40),
        (16, "line\nline\nline\nline\nline"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), 1, 2, "m", 3, "x", "d", "t", [1]) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def texts(spark):
    """Whole texts of the smallest documents table, ascending ids."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text or "") for r in rows]


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.fixture(scope="session")
def ordered():
    return lambda rows: sorted((tuple(r) for r in rows), key=key)
