import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hazegrid.session import local_session

    s = local_session(4, "hazegrid-tests")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    return s


T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def hourly(spark):
    """series(name=[values...]) -> hourly frame with one column ``x`` (and row gaps by hours=)."""

    def make(hours=None, **series):
        rows = [
            (name, T0 + dt.timedelta(hours=(hours or range(len(vs)))[i]), None if v is None else float(v))
            for name, vs in series.items() for i, v in enumerate(vs)
        ]
        return spark.createDataFrame(rows, "series_id string, ts timestamp, x double")

    return make


def column(df, name="x", series=None):
    rows = df.where(df.series_id == series).collect() if series else df.collect()
    return [r[name] for r in sorted(rows, key=lambda r: (r.series_id, r.ts))]


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few rows, so that short test series cross many block borders."""
    from hazegrid.plans import blocks

    monkeypatch.setattr(blocks, "DEFAULT_BLOCK_ROWS", 5)
