import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # executors import the package too
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomwright.plans.session import local_session

    return local_session("4", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def sf():
    return SF
