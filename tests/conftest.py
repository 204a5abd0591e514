import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.dont_write_bytecode = True


@pytest.fixture(scope="session")
def spark():
    from curatrix.functions.session import session

    folder = tempfile.mkdtemp(prefix="spark-")
    s = session("tests", cores="4", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
