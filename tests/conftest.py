import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sensorloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    yield session
    session.stop()


@pytest.fixture
def at():
    """Timestamp `minutes` (and seconds) after a fixed start."""
    start = dt.datetime(2024, 1, 1)
    return lambda minutes, seconds=0: start + dt.timedelta(minutes=minutes, seconds=seconds)


@pytest.fixture(scope="session")
def noisy(spark):
    """Three series of very different length with uneven steps, missing values and repeated values."""
    import numpy as np

    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for asset, n in (("A001", 400), ("A002", 60), ("A003", 3)):
        gaps = rng.choice([60, 60, 60, 300, 7200], size=n)
        if asset == "A001":
            gaps[:150] = 1  # a dense stretch, so that equal-width slices are uneven
        times = start + np.cumsum(gaps) * dt.timedelta(seconds=1)
        values = rng.integers(0, 40, size=n) / 4
        for i in range(n):
            missing = rng.random() < 0.2
            rows.append((asset, "v", times[i], None if missing else float(values[i]), i))
    return spark.createDataFrame(rows, "asset string, variable string, timestamp timestamp_ntz, value double, seq bigint")
