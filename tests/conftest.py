import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siltworks.session import session

    shared = tmp_path_factory.mktemp("shared")
    made = session("local[4]", 4, spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file://{shared}")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture()
def rows():
    return lambda df, *columns: sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())
