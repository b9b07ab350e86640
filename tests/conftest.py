import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomgraph.session import session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    folder = tmp_path_factory.mktemp("shared")
    conf = {"spark.master": "local[4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": f"file://{folder}/warehouse", "spark.driver.memory": "4g"}
    s = session("tests", **conf)
    s.sparkContext.setLogLevel("ERROR")
    return s
