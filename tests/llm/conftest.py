from __future__ import annotations

import os
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="session")
def spark(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [spark.sparkContext.environment.get("PYTHONPATH", ""), ROOT]))
    return spark


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, l string, x string, quality_score string, _id string, least string, times string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang]) rows, with extra columns whose names the operators use inside."""

    def build(rows):
        full = [(*(r + ("en",))[:3], "src", len(r[1] or ""), "f", "r", "l", "x", "q", "i", "e", "t") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


AWKWARD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "two words"), (6, "the same text of the copies here"), (6, "the same text of the copies here"), (7, "the same text of the copies here"), (None, "no id at all in this row"), (8, "x" * 50_000), (9, "a b " * 20_000)]
