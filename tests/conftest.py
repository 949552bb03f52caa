import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from textlab.session import get_session

    session = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session
