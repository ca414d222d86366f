"""Run records: states, reasons and what is complete."""

import pytest

from gridsieve.config import PreprocessingConfig
from gridsieve.operators import results as rs
from gridsieve.sources import readers, sinks


def record(spark, path, inputs, produced, reasons=()):
    areas = lambda names: spark.createDataFrame([(n,) for n in names], "aoi string")
    why = spark.createDataFrame(list(reasons), "aoi string, reason string")
    sinks.write_run_record(rs.area_status(areas(inputs), areas(produced), why), PreprocessingConfig(), path)
    back = readers.read_run_record(spark, path)
    rows = lambda name: sorted(tuple(r) for r in back[name].collect())
    return rows("successful"), rows("failed"), rows("summary")


def test_states_and_reasons(spark, tmp_path):
    """Repeated rows, several reasons, a reason of a good area, an unknown output, a null area."""
    good, bad, summary = record(
        spark, str(tmp_path / "run"), ["A", "A", "B", "C", "D", None], ["A", "D", "Z", None],
        [("B", "no dtm"), ("B", "late"), ("A", "ignored"), (None, "x")],
    )
    assert good == [("A",), ("D",)]
    assert bad == [("B", "late"), ("C", rs.NO_REASON)]
    assert summary == [(2, 2, 50.0)]


def test_one_state_or_no_area(spark, tmp_path):
    assert record(spark, str(tmp_path / "a"), ["A"], ["A"]) == ([("A",)], [], [(1, 0, 100.0)])
    assert record(spark, str(tmp_path / "b"), ["A"], []) == ([], [("A", rs.NO_REASON)], [(0, 1, 0.0)])
    assert record(spark, str(tmp_path / "c"), [], []) == ([], [], [(0, 0, 0.0)])


def test_a_record_without_summary_is_incomplete(spark, tmp_path):
    status = spark.createDataFrame([("A", True, None)], "aoi string, ok boolean, reason string")
    status.write.partitionBy("ok").json(str(tmp_path / "areas"))
    with pytest.raises(Exception, match="summary"):
        readers.read_run_record(spark, str(tmp_path))
