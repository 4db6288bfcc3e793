import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weft.session import session, ship

    made = session("local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "4g"})
    made.sparkContext.setLogLevel("ERROR")
    yield ship(made)
    made.stop()
