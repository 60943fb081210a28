"""Names of the entry module, and some queries against their SQL on the smallest tables; the driver holds all of them against it."""

import importlib.util
import os

import pytest

from strandix.plans import registry

SMOKE = "/root/testdata/sf0.001"


def test_entry_module_names_match():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMOKE) or importlib.util.find_spec("duckdb") is None, reason="no tables or no DuckDB")
@pytest.mark.parametrize("name", ["read_report_total", "kmer_table", "buckets", "weight_runs", "protein_kmer_count", "degree_histogram", "reordering_accounting", "packed_functions", "skew_partitions", "locate_offsets", "weighted_fasta_dictionary", "read_report_percent", "members_forward_only", "mixed_reads"])
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.execute(f"create view {t} as select * from '{SMOKE}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMOKE)
    want = c.execute(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    key = lambda r: [(v is not None, v) for v in r]
    rows = sorted((tuple(r[names.index(x)] for x in columns) for r in want.fetchall()), key=key)
    assert sorted((tuple(r[x] for x in columns) for r in got.collect()), key=key) == rows
