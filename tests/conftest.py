from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanveil.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "4g", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
