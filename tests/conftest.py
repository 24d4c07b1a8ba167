from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def local_session():
    from wicara.session import build_session

    spark = build_session(
        "wicara-tests",
        f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        spark_ui_enabled="false",
        spark_sql_shuffle_partitions="8",
        spark_driver_memory="8g",
        spark_wicara_inputPartitions="8",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
