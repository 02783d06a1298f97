import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from glosswork.session import local_session

    s = local_session("4", 4, "3g")
    yield s
    s.stop()


SEGMENTS = "seg_id bigint, doc_id bigint, seg_index int, text string, kind string, page int, section string, font_colors array<string>, document_source_id bigint"


@pytest.fixture(scope="session")
def segments(spark):
    """Segments from (doc_id, text, kind, page, section) in their order; extra columns with clashing names come along."""

    def make(rows, colors=()):
        out = [(i + 1, d, i, t, k, p, s, list(colors), 1) for i, (d, t, k, p, s) in enumerate(rows)]
        return spark.createDataFrame(out, SEGMENTS)

    return make
