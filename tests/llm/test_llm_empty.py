"""Every llm query over empty tables, and over rows that are null in all but their keys."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from glosswork.llm import queries

DATA = Path("/root/testdata/sf0.001")
KEYS = {"id", "doc_id", "seg_id", "finding_id", "item_id", "source"}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("rows", [0, 5])
def test_llm(spark, tmp_path, rows):
    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f).slice(0, rows)
        for i, c in enumerate(t.schema):
            if c.name not in KEYS:
                t = t.set_column(i, pa.field(c.name, c.type), pa.nulls(len(t), c.type))
        pq.write_table(t, tmp_path / f.name)
    for name, query in queries.QUERIES.items():
        found = query(spark, str(tmp_path)).count()
        assert found == 0 or not name.endswith("_found")
