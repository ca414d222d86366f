import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridsieve.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def raster(spark, aoi, **channels):
    """A dense pixel table from 2-D lists or arrays; NaN becomes NULL."""
    import numpy as np

    names = list(channels)
    arrays = [np.asarray(channels[n], dtype=float) for n in names]
    h, w = arrays[0].shape
    clean = lambda v: None if np.isnan(v) else float(v)
    rows = [
        (aoi, r, c, *[clean(a[r, c]) for a in arrays]) for r in range(h) for c in range(w)
    ]
    schema = "aoi string, row int, col int, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def as_array(df, value, h, w):
    import numpy as np

    out = np.full((h, w), np.nan)
    for r in df.collect():
        v = r[value]
        out[r["row"], r["col"]] = np.nan if v is None else v
    return out
