import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tarn.session import local_session

    session = local_session(8, "6g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
