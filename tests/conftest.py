import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftline.session import local_session
    from weftline.streaming.memory_state import ROCKSDB

    root = tmp_path_factory.mktemp("shared")
    return local_session(
        4, "tests", spark__checkpoint__dir=f"file://{root}", spark__sql__warehouse__dir=f"{root}/warehouse", spark__sql__streaming__stateStore__providerClass=ROCKSDB
    )
