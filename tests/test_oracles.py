"""Every registered query with SQL gives DuckDB's rows, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from auspex.plans import catalog

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return [value(y) for y in x]
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str([value(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_agree(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    told = duck.execute(catalog.ORACLES[name])
    want = table([c[0] for c in told.description], told.fetchall())
    assert table(found.columns, [tuple(r) for r in found.collect()]) == want


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    for path in Path(SF).glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(str(tmp_path / path.name))
    for name in ("all_findings", "findings_dedup", "package_score_independent", "infra_clusters", "event_sessions", "cache_lookup", "campaign_state", "campaign_state_batch", "infra_merges", "sampled_versions", "build_metadata", "host_artifacts", "shift_obfuscation"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
