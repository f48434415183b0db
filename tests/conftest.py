import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from docquarry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "docquarry-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tree(tmp_path):
    """Writes files below a temporary content root and returns the root."""

    def write(**files: str):
        for name, text in files.items():
            put(name, text)
        return str(tmp_path / "root")

    def put(name: str, text: str):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())

    write.put = put
    write.root = str(tmp_path / "root")
    os.makedirs(write.root, exist_ok=True)
    return write
