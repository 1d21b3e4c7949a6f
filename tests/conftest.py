import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from passagemill.session import build_session

    return build_session("4", 4, **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
