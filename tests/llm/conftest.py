import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, h string, n long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, g, None, None, 7, "x", None) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and one without an id."""
    long_ = prose(1, 60_000)
    same = prose(2, 120)
    texts = [None, "", " \t\n", long_, same, same, same + " tail", "x", "É ß İ 12.5 km", prose(3, 300), prose(3, 300)]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    return make_docs(texts + ["no id here"], ids + [None])
