"""Every registered query against its DuckDB statement, and some with all keys cut."""

import oracle
import pytest

import __spark_entry__ as registered
from spikeframe.layout import BROADCAST_ROWS_CONF, ROWS_PER_SLICE_CONF

QUERIES, ORACLES = registered.queries(), registered.oracle_sql()
CUT = ["ingest_text", "spikes_with_meta", "layer_filter", "active_filter_excl", "channel_filter", "spikes_labelled",
       "isi_positional", "burst_features", "syncburst_bins", "syncspike_labels", "ks_test", "burst_similarity"]


@pytest.fixture(scope="module")
def tables():
    connections = {sf: oracle.connect(sf) for sf in ("0.001", "0.01")}
    yield connections
    for c in connections.values():
        c.close()


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, f"{oracle.DATA}/sf0.01")
    if name in ORACLES:
        assert oracle.difference(df, tables["0.01"], ORACLES[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", CUT)
def test_query_with_every_key_cut(spark, tables, settings, name):
    settings(ROWS_PER_SLICE_CONF, 20)
    settings(BROADCAST_ROWS_CONF, 0)
    df = QUERIES[name](spark, f"{oracle.DATA}/sf0.001")
    assert oracle.difference(df, tables["0.001"], ORACLES[name]) is None


def test_entry(spark):
    rows = {r.fileName: r.burst_n for r in registered.entry(spark).collect()}
    assert sum(rows.values()) == 12 and len(rows) == 2


def test_known_counts(spark):
    """Bursts of the test data at two thresholds."""
    for sf, dense, sparse in (("0.001", 12, 1), ("0.01", 192, 6)):
        data = registered.load(spark, f"{oracle.DATA}/sf{sf}")
        assert data.bursts(2500).count() == dense and data.bursts(1000).count() == sparse
