import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from strandwork.session import local_session

    # tables are tiny here: compiling a stage costs more than running it
    s = local_session(4, "tests", "4g", spark__sql__codegen__wholeStage="false")
    yield s
    s.stop()
