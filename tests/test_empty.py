"""Every query over empty tables, and over rows that are null in all but their keys."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as e
from glosswork.plans import core_queries

DATA = Path("/root/testdata/sf0.001")
KEYS = {"id", "doc_id", "seg_id", "finding_id", "item_id", "source"}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def bare_tables(target, rows):
    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f).slice(0, rows)
        for i, c in enumerate(t.schema):
            if c.name not in KEYS:
                t = t.set_column(i, pa.field(c.name, c.type), pa.nulls(len(t), c.type))
        pq.write_table(t, target / f.name)
    return str(target)


@pytest.mark.parametrize("rows", [0, 5])
def test_core(spark, tmp_path, rows):
    root = bare_tables(tmp_path, rows)
    for name in core_queries.QUERIES:
        e.queries()[name](spark, root).count()
