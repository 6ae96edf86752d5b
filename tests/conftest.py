import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from nocturne.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def night_frame(spark):
    """Night rows from plain lists: ``night_frame(hr=[...], rr=[...])``."""

    def build(hr, rr=None, gyro=None, movement=None, step=1, user=1, start=1704139200):
        n = len(hr)
        rr = rr or [60000.0 / h if h else None for h in hr]
        rows = [
            (user, "2024-01-02", start + i * step, int(hr[i]), rr[i], 0.0, 0.0, 1.0,
             float((movement or [0.0] * n)[i]), float((gyro or [0.0] * n)[i]), 97)
            for i in range(n)
        ]
        return spark.createDataFrame(
            rows, "user_id long, night string, timestamp long, hr int, rr1_ms double, acc_x double, acc_y double, "
            "acc_z double, movement double, gyro double, spo2 int"
        )

    return build
