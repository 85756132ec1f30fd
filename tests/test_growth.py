"""Plans that hold on larger tables: made rows are never broadcast, and no task makes a whole table's rows."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from lumenfold.plans import catalog

SF = "/root/testdata/sf0.001"


def planned(spark, monkeypatch, name):
    """The plans of a query's own rounds and of its result."""
    plans, kept = [], DataFrame.checkpoint

    def noted(self, *args, **more):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return kept(self, *args, **more)

    monkeypatch.setattr(DataFrame, "checkpoint", noted)
    plans.append(catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    return plans


@pytest.mark.parametrize("name", ["d24_j29_fixes", "k8_patches", "k8_applied"])
def test_made_rows_are_not_broadcast(spark, monkeypatch, name):
    assert not any("Broadcast" in p for p in planned(spark, monkeypatch, name))


@pytest.mark.parametrize("name", ["g2_j22_import_edges", "g1_scan_set"])
def test_import_names_are_not_broadcast(spark, monkeypatch, name):
    assert not any("Broadcast" in p for p in planned(spark, monkeypatch, name))


def test_cross_file_rows_are_not_broadcast(spark, monkeypatch):
    assert not any("Broadcast" in p for p in planned(spark, monkeypatch, "j20_j21_w4_cross_file_taint"))


def dealt(spark, name):
    return catalog.QUERIES[name](spark, SF).rdd.getNumPartitions()


@pytest.mark.parametrize("name", ["d15_c_races", "d15_python_races", "d15_go_races", "d15_java_races", "s20_pyproject", "s22_cargo"])
def test_a_table_of_one_row_group_is_dealt_over_the_cores(spark, name):
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    assert dealt(spark, name) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["d10_local_taint", "f23_changed_lines", "k3_sarif_documents", "g14_tainted_names", "g15_sink_violations", "g10_x9_summaries", "j19_f3_import_targets"])
def test_rows_are_dealt_before_they_are_made(spark, monkeypatch, name):
    assert any("REPARTITION_BY_NUM" in p for p in planned(spark, monkeypatch, name))


@pytest.mark.parametrize("name", ["g8_taint_with_kills", "g9_x3_tainted_sinks"])
def test_taint_takes_no_rounds_over_all_functions(spark, monkeypatch, name):
    plans = planned(spark, monkeypatch, name)
    assert len(plans) == 1 and "Broadcast" not in plans[0]
