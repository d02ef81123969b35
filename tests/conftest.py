import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from voxmill.session import get_spark

    session = get_spark("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
