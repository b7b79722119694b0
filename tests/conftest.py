import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from postwatch import session

    warehouse = tmp_path_factory.mktemp("warehouse")
    built = session.local_session(8, 4, **{"spark.sql.warehouse.dir": str(warehouse)})
    yield built
    built.stop()


@pytest.fixture()
def rows():
    """Rows of a frame as sorted tuples."""

    def collect(frame, *columns):
        chosen = frame.select(*columns) if columns else frame
        return sorted((tuple(r) for r in chosen.collect()), key=repr)

    return collect
