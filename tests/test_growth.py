"""Work that grows with a table is dealt to tasks, though its file has one row group, and is done once for each row."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from framewright import engine_queries as eq
from framewright import queries as q
from framewright.functions import columns as c
from framewright.functions import containers as ct
from framewright.functions import exact as ex

from .conftest import SF


def tasks(spark, name: str) -> int:
    """How many tasks of a query give rows."""
    return q.QUERIES[name](spark, SF).select(F.spark_partition_id()).distinct().count()


@pytest.mark.parametrize("name", ["iso_media", "avi_media", "iso_faults", "avi_faults", "container_layout"])
def test_files_are_made_in_several_tasks(spark, name):
    assert tasks(spark, name) > 1


def test_boxes_are_read_once_for_all_faults_of_a_file(monkeypatch):
    how = {"rate": Fraction(25), "width": 3, "height": 4, "jpeg": True}
    read, asked = ct._read_boxes, []
    monkeypatch.setattr(ct, "_read_boxes", lambda data: asked.append(len(data)) or read(data))
    for plain, kinds, calls in ((eq.iso_of(7, how | {"turn": "rot90"}), eq._iso_faults(), eq.ISO_CALLS), (eq.avi_of(7, how, "mjpeg"), eq._avi_faults(), eq.AVI_CALLS)):
        with_faults = lambda data: [ct.inject(data, calls.get(k, (k, {}))[0], **calls.get(k, (k, {}))[1]) for k in kinds]  # noqa: B023, E731
        want = with_faults(plain)
        asked.clear()
        assert with_faults(ct.Parsed(plain)) == want
        assert len(asked) == 1


@pytest.mark.parametrize("name", ["motion_positions", "camera_transform"])
def test_frames_are_made_in_several_tasks(spark, name):
    assert tasks(spark, name) > 1


@pytest.mark.parametrize("name", ["motion_positions", "trig_turns"])
def test_code_of_sines_is_short_enough_to_be_compiled(spark, name):
    """The JVM compiles no method of more than 8000 bytes; longer ones are interpreted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans show no code before they run
    try:
        said = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(q.QUERIES[name](spark, SF)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", said)
    assert sizes and max(map(int, sizes)) < 8000


def test_sines_equal_exact_ones_at_all_quarters_and_between(spark):
    turns = [(n, d) for d in (1, 2, 3, 4, 16, 97, 360, 16_777_259) for n in {k * d // 4 + e for k in range(-5, 6) for e in (-1, 0, 1)} | set(range(-20, 21))]
    t = spark.createDataFrame(turns, "n long, d long")
    got = t.select("n", "d", c.sine(F.col("n"), F.col("d")), c.sine(F.col("n"), F.col("d"), cosine=True)).collect()
    assert len(got) == len(turns)
    assert [tuple(r) for r in got] == [(n, d, *(int(f(Fraction(n, d)) * ex.SINE_SCALE) for f in (ex.sin_turns, ex.cos_turns))) for n, d in turns]
