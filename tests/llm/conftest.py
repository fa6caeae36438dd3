from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldcheck.llm.common import ready  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, spans string, n string"


@pytest.fixture
def docs(spark):
    """Builds a documents table with extra columns whose names clash with the operators' own."""
    ready(spark)

    def build(rows: list[tuple]):
        full = [(i, t, lang, "s", len(t or ""), "x", "y", "z") for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS)

    return build
