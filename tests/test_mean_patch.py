"""The mean patch straight from pixels."""

import numpy as np
from conftest import raster

from gridsieve.config import PatchGrid
from gridsieve.operators.models import embedding


def test_one_python_worker_for_every_task_adds_up_the_mean_patch(spark):
    rng = np.random.default_rng(5)
    dtm, ndvi = rng.normal(size=(2, 8, 8))
    dtm[2, 3] = np.nan
    pixels = raster(spark, "a", dtm=dtm, ndvi=ndvi)
    mean = embedding.mean_patch_of_pixels(pixels, PatchGrid(4, 2), 0.5, ("dtm", "ndvi"))
    assert "MapInArrow" not in mean._jdf.queryExecution().optimizedPlan().toString()
    spans = [(r, c) for r in range(0, 5, 2) for c in range(0, 5, 2)]
    wanted = [
        np.nanmean([x[r : r + 4, c : c + 4] for r, c in spans], axis=0).ravel() for x in (dtm, ndvi)
    ]
    rows = mean.orderBy("pos").collect()
    assert np.allclose([[r["dtm"] for r in rows], [r["ndvi"] for r in rows]], wanted)
