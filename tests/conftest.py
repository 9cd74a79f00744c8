import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bulletin.session import session

    spark = session(
        "local[4]", "tests", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__sql__streaming__metricsEnabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
