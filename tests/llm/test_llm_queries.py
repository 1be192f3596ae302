import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle_check import DIRECTORY, same_rows  # noqa: E402

from pruefwerk import llm  # noqa: E402

COLUMNS = {
    "p1_found": ["field", "record_id"], "p2_found": ["field", "id_a", "id_b"], "p3_found": ["field", "record_id", "defect"],
    "p4_found": ["field", "record_id", "noise"], "p5_found": ["field", "record_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind"],
}
pytestmark = pytest.mark.skipif(not DIRECTORY.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, name):
    df = llm.queries()[name](spark, str(DIRECTORY))
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len({tuple(map(str, r)) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    same_rows(spark, llm.queries()[name], llm.oracle_sql()[name])
