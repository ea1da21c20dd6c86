"""A session for the operators of this folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))


@pytest.fixture(scope="session")
def spark():
    from wordkin.session import local_session, python_ready

    return python_ready(local_session(4, "wordkin-llm-tests", 4))
