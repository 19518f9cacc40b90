"""Awkward tables for the corpus operators."""

import pandas as pd
import pytest

AWKWARD = [
    (3, "The cat sat on the mat.\nThe cat sat on the mat.\nAnother line", "en", "a"),
    (1, None, None, None),
    (2, "", "en", "a"),
    (4, " \t\n ", "xx", None),
    (3, "The cat sat on the mat.\nThe cat sat on the mat.\nAnother line", "en", "a"),
    (5, "Ünïcödé  wörds   über alles  end  x", "de", "b"),
    (None, "Licensed under CC BY-NC 4.0. All rights reserved. " * 3, "en", "b"),
    (7, "a" * 5000, None, "c"),
    (8, "word " * 300, "en", "c"),
    (9, "12345 !!! ###", "en", "c"),
    (10, "x" + "\n" * 50 + "y", "fr", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with likely names."""
    rows = [(i, t, lang, s, len(t or ""), "extra", 1.5, [1]) for i, t, lang, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, word array<int>")


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return spark.createDataFrame([], awkward.schema)


@pytest.fixture(scope="session")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture
def on_table(spark, tmp_path):
    """Runs a registered query over a table of documents given as a DataFrame."""

    def run(query, df, **others):
        df.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
        for name, other in others.items():
            other.write.parquet(str(tmp_path / f"{name}.parquet"))
        return query(spark, str(tmp_path)).toPandas()

    return run
