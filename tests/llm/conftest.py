import random

import pytest

LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(6000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block string, node int, label string, part int, kept string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Ids and texts with all that may go wrong: missing, empty, blank, very long, repeated, near, shared."""
    a, b, shared = prose(1, 120), prose(2, 200), prose(3, 60)
    words = b.split()
    return [
        (1, a), (2, None), (3, ""), (4, " \t\n\x0b"), (5, a), (6, b), (7, " ".join([*words[:50], "changed", *words[51:]])),
        (8, f"{prose(4, 80)} {shared} {prose(5, 30)}"), (9, f"{shared}\n{shared}"), (10, LONG), (11, "one"), (12, "one two three four"),
        (12, "one two three four"), (13, "é漢字 ▁   <|endoftext|> ａ\r\n" * 9), (14, "ab" * 400), (14, f"other {shared}"),
        (None, f"no id {shared}"), (None, None), (-5, f"{prose(6, 20)} {a}"), (50, prose(7, 300)), (51, "line of five words here\n" * 20),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same as documents with columns whose names are used inside the operators; some are all missing."""
    return spark.createDataFrame(
        [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 2}", 0, "b", None, None, k, "x") for k, (i, t) in enumerate(odd_rows)], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def vocabulary():
    from repometrics.llm.queries import vocabulary_path

    return vocabulary_path
