import os

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


def test_core_stands_without_the_text_subpackage():
    import re
    from pathlib import Path

    here = Path(entry.__file__).parent
    for p in (here / "notewarp").rglob("*.py"):
        if "llm" not in p.relative_to(here).parts:
            assert not re.search(r"notewarp\.llm|from \.llm|import llm", p.read_text()), p


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
