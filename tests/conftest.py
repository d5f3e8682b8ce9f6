import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from versio.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app="versio-tests", shared=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def write_lines(path, lines, raw=False):
    mode = "wb" if raw else "w"
    with open(path, mode, **({} if raw else {"encoding": "utf-8", "newline": ""})) as f:
        for ln in lines:
            f.write(ln + (b"\n" if raw else "\n"))
