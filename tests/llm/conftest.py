"""Odd documents that every operator must take: nulls, empty, long, repeated, clashing columns."""

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "fp long, size long, score double, bucket int, row long, part int, _slot int, component_id long")


def odd_rows():
    long = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
    texts = [(0, "The red fox ran over the long hill and rested there."), (1, None), (2, ""), (3, " \n\t "), (4, "one"),
             (5, "two words"), (6, "The red fox ran over the long hill and rested there."), (7, long), (8, long + " end"),
             (None, "The red fox ran over the long hill and rested there."), (None, None), (5, "two words"),
             (9, "é漢字 ünï cödé 🙂 <|endoftext|> tail"), (10, "trailing \n"), (11, "  leading"), (12, "a\n\nb\r\nc")]
    rows = []
    for k, (i, t) in enumerate(texts):
        source = [None, "s", "t", ""][k % 4]
        rows.append((i, t, "en" if k % 3 else None, source, None if t is None else len(t),
                     1, 2, 0.5, 3, 4, 5, 6, 7))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
