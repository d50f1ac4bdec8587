from __future__ import annotations

from types import SimpleNamespace

import pytest

from corpusgauge.plans.queries import QUERIES
from corpusgauge.session import shared_folder, stored


def session(master: str, named: str | None):
    conf = SimpleNamespace(get=lambda key, default: named, set=lambda key, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_has_to_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master, None))
        assert shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(session("local[4]", None))


def test_stored_tables_lie_below_it(spark):
    table = stored(spark.range(5), "five")
    assert sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4]
    assert all("corpusgauge-five-" in f for f in table.inputFiles())


def test_building_a_report_query_runs_no_job(spark):
    spark.sparkContext.setJobGroup("building", "no job expected")
    QUERIES["md_quality"](spark, "/root/testdata/sf0.001")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("default", "")
