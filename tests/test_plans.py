"""The plans that the operators should have."""

import contextlib
import io

import pytest

from crestline import queries
from crestline.operators import sample as sampling
from crestline.operators.sample import FULLRES, sample
from crestline.operators.summary import histogram
from crestline.sources.raster import Dem


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dem") / "rows")
    held = queries.dem(spark, sf)
    held.rows.write.parquet(path)
    return Dem(spark.read.parquet(path), held.transform, held.n_rows, held.n_cols, scale=0.5)


def test_a_window_reaches_the_scan(kept):
    text = plan(kept.part(-10, 10, 0, 40).heights())
    assert "PushedFilters" in text and "GreaterThanOrEqual(row" in text and "LessThanOrEqual(row" in text


def test_small_rasters_are_broadcast_and_large_ones_joined(spark, sf, kept, monkeypatch):
    points = queries._points(spark, sf)
    assert "BroadcastHashJoin" in plan(sample(points, kept, FULLRES))
    monkeypatch.setattr(sampling, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" in plan(sample(points, kept, FULLRES))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_needed_columns_are_read(spark, sf):
    text = plan(queries.polar_columns(spark, sf))
    assert "ReadSchema: struct<c_custkey:bigint>" in text


def test_slopes_are_aggregated_before_the_shuffle(spark, sf):
    text = plan(queries.horizon_scan_sql(spark, sf))
    assert text.index("partial_max") < text.index("Exchange", text.index("partial_max")) and "CartesianProduct" not in text


def test_histograms_count_before_the_shuffle(spark, sf):
    assert "partial_count" in plan(histogram(queries._results(spark, sf), "worst_angle_deg"))


def test_tiles_shuffle_no_samples(spark, sf):
    """What is shuffled by cell are targets and pieces of raster rows; the kernel's samples are never rows."""
    text = plan(queries.horizon_scan_tiles(spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "hashpartitioning(cell" in text and "sin_arc" not in text
