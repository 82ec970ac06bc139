import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]
# Python workers import the library and the test modules too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from granary.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def chunk_frame(spark):
    """Makes a chunk table from short rows: (chunk_id, doc_id, index, text, **extras)."""
    from granary.schema import CHUNK

    def make(rows):
        out = []
        for r in rows:
            chunk_id, doc_id, index, text, *rest = r
            extra = rest[0] if rest else {}
            out.append((chunk_id, doc_id, extra.get("source_file", doc_id), index, None, None, None, extra.get("module"), text, extra.get("metadata", "{}")))
        return spark.createDataFrame(out, CHUNK)

    return make
