import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session
    s = get_session("local[8]", 8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as plain tuples, in the DataFrame's column order or ``cols``."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
