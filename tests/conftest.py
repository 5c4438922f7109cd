import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from tessera.session import session

    made = session("local[8]", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "8"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
