import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text)."""

    def make(texts, **more):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        return spark.createDataFrame([(d, t, "en", f"src{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, (d, t) in enumerate(rows)], SCHEMA)

    return make
