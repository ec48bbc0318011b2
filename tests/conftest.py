import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from check import session

    return session()


@pytest.fixture
def small_limits(monkeypatch):
    """Shrink every size limit, so that small frames take the paths of large ones."""
    from tablewright.operators import blocks, density, metric
    from tablewright.plans import grouped, ordered, selection

    monkeypatch.setattr(ordered, "CHUNK_ROWS", 300)
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    monkeypatch.setattr(selection, "EXACT_ROWS", 200)
    monkeypatch.setattr(grouped, "GROUP_ROWS", 20)
    monkeypatch.setattr(grouped, "RADIX", 4)
    monkeypatch.setattr(metric, "BLOCK_ROWS", 40)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 60)
    monkeypatch.setattr(density, "BLOCK_ROWS", 40)
    monkeypatch.setattr(density, "PAIRS_AT_ONCE", 30)
