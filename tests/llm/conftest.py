import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    """A-Z lower-cased, nothing else."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture
def docs(spark):
    """Frame of (doc_id, text) rows with columns whose names clash with results."""

    def make(*texts, ids=None):
        rows = [(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        schema = (
            "doc_id long, text string, quality_signals string, contamination int"
        )
        return spark.createDataFrame(rows, schema)

    return make
