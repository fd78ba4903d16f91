import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from reqloom.session import local_session

    return local_session(4, shuffle=4, memory="4g", spark__ui__showConsoleProgress="false")
