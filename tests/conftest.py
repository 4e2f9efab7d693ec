from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docdelta.plans.session import local_session

    session = local_session("tests", cpus="4", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("docdelta.scratch.dir", f"file://{tmp_path_factory.mktemp('scratch')}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
