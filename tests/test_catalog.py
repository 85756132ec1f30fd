"""Each query against its SQL in DuckDB, on the smallest tables."""

import json
import os

import duckdb
import pandas as pd
import pytest

from lumenfold.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v != v else (f"{v:.6f}" if isinstance(v, float) else str(v)))
        df[c] = df[c].str.replace(r"\.0+$", "", regex=True)
    return sorted(map(tuple, df.to_numpy()))


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    told = catalog.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"create view {table.removesuffix('.parquet')} as select * from '{SF}/{table}'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(told.columns) == sorted(want.columns)
    assert len(told) and tidy(told) == tidy(want)


def test_sarif_results_parse(spark):
    rows = catalog.QUERIES["k3_sarif"](spark, SF).collect()
    # what each severity is called there (fixed values)
    want = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "warning"}
    level = {rule[3]: want[rule[4]] for rule in catalog.RULES}
    assert rows
    for r in rows:
        told = json.loads(r.value)
        place = told["locations"][0]["physicalLocation"]
        assert (told["ruleId"], told["level"]) == (r.issue, level[r.issue])
        assert (place["artifactLocation"]["uri"], place["region"]["startLine"]) == (str(r.path), r.line)


def test_bill_head_and_components_make_a_document(spark):
    from lumenfold.operators import reports

    rows = catalog.QUERIES["k4_bill_of_materials"](spark, SF).count()
    head = json.loads(reports.bill_head("app", "1", "2024-01-01T00:00:00Z", "0"))
    assert rows == spark.read.parquet(f"{SF}/part.parquet").count()
    assert head["specVersion"] == "1.4" and head["metadata"]["component"]["bom-ref"] == "root-app"
