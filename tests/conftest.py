import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scarpline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "2",
        "spark.default.parallelism": "2",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-checkpoint-"),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
    })
    yield spark
    spark.stop()
