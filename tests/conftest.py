from __future__ import annotations

import pytest

from panelgrid.session import build_session, with_own_folder


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    with_own_folder(session).sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
