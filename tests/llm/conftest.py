import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp string, size string, __h string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = "of the anning heed thation " * 8_000
    rows = [(1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "en", None), (4, "the cat sat on a mat", "en", "a"), (4, "the cat sat on a mat", "en", "a"),
            (None, "the cat sat on a mat", None, None), (5, "THE CAT sat on a mat", "en", "é"), (6, long, "en", "a"), (7, "%% 12 ..", "fr", "b"),
            (8, "x" * 200_000, "de", "b"), (9, "日本語 😀 ▁ é́ <|endoftext|>", None, "z"), (9, "another text", "en", "z")]
    return spark.createDataFrame([(*r, None, "c", "c", None, "h") for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
