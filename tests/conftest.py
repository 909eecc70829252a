import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumatable.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, partitions=4, shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def image_rows(spark, arrays):
    """(image_id, h, w, data) from numpy arrays (grey or RGB)."""
    rows = [(i, a.shape[0], a.shape[1], [float(v) for v in a.reshape(-1)]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_id bigint, h int, w int, data array<double>")


def planes(df, names, count):
    """Pixel table back to numpy: {name: [array per image]}."""
    pdf = df.toPandas()
    out = {name: [] for name in names}
    for i in range(count):
        part = pdf[pdf["image_id"] == i].sort_values(["y", "x"])
        h, w = int(part["y"].max()) + 1, int(part["x"].max()) + 1
        assert len(part) == h * w
        for name in names:
            out[name].append(part[name].to_numpy(dtype=float).reshape(h, w))
    return out
