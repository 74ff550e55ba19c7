"""Every registered query of the library against its SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import connect, rows_of, rows_of_sql  # noqa: E402

from docloom.plans import bindings, layout_bindings, region_bindings, selection_bindings  # noqa: E402, F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    cols, rows = rows_of(bindings.QUERIES[name](spark, sf_dir))
    if name in bindings.SQL:
        assert (cols, rows) == rows_of_sql(con, bindings.SQL[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "doc_id", "chunk_index", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
