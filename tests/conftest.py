from __future__ import annotations

import pytest

from catalog.check import session


@pytest.fixture(scope="session")
def spark():
    return session()
