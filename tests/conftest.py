import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldstone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def base_paths():
    """Paths of the complete base inventory: 24 groups of 60."""
    out = []
    for actor in range(1, 25):
        for emotion in range(1, 9):
            for intensity in (1, 2):
                if emotion == 1 and intensity == 2:
                    continue
                for statement in (1, 2):
                    for take in (1, 2):
                        name = f"{emotion:02d}-{intensity:02d}-{statement:02d}-{take:02d}-{actor:02d}.wav"
                        out.append((f"/data/Person{actor:02d}/{name}",))
    return out


@pytest.fixture(scope="session")
def inventory(spark, base_paths):
    from foldstone.operators import inventory as I

    rows = I.strict(I.parse_base(spark.createDataFrame(base_paths, "path string"))).drop("path")
    return rows.cache()
