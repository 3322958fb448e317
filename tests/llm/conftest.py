from __future__ import annotations

import pytest

#: doc_id may be null or repeated, texts null, empty, of white space only, very long; other columns clash with names the operators use.
AWKWARD = [
    (1, "Hello world, this is a short text about nothing at all.", "en", "a", 1),
    (1, "Hello world, this is a short text about nothing at all.", "en", "a", 1),
    (2, "", "en", "a", 2),
    (3, None, None, None, 3),
    (None, "a row without a name", "en", "b", 4),
    (4, "   \n\t ", "en", "b", None),
    (5, "x" * 60_000, "en", None, 5),
    (6, "Großes ß, kurzer Text. " * 3_000, "de", "c", 6),
    (7, "🙂 don't 's　日本語 <|endoftext|> 42", None, "c", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, {extra} int"


@pytest.fixture
def awkward(spark):
    """Makes the table with an extra column of a given name."""
    return lambda extra="size": spark.createDataFrame(AWKWARD, SCHEMA.format(extra=extra))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA.format(extra="size"))


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
