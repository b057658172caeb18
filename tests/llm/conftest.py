import random

import pytest

#: Documents with every oddity: nulls, empty and blank texts, repeated rows and ids, long texts, other scripts.
WORDS = "the quick brown fox jumps over a lazy dog while rain falls on quiet hills and rivers run Ñandú étude straße 東京 x1 42 don't end".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + (".\n" if rnd.random() < 0.08 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 60)
    near = a.replace("quick", "slow", 1)
    rows = [
        (1, a), (2, a), (3, near), (4, b), (5, None), (6, ""), (7, "  \n\t\n"), (8, "word"), (9, "Word"), (None, a), (None, None),
        (10, prose(3, 6000)), (10, "same id, other text"), (11, b), (11, b), (-5, "A b C d e f g h i j k l m n o p"),
        (12, "mail me at jane.doe+x@mail.example.com or +1 (555) 010-9999, host 10.20.30.40, card 4111 1111 1111 1111 ok"),
        (13, "bad 256.1.1.1 and 4111111111111112 and +12 3 and a@b and 1.2.3.4.5.6.7.8"),
        (14, "naïve\x00line\r\nwith\x0bodd \x1c spaces　and \U0001f600 emoji " * 3), (15, "go " * 40), (16, "x" * 5000), (2**40, "far id " + b),
    ]
    return [(i, t, "en" if k % 2 else None, f"src{k % 3}", None if t is None else len(t), k, "clash") for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, document string"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd documents as a table on disk, in two files."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(2, "row").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
