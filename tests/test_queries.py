"""Core queries at the smallest scale against their SQL."""

import pytest
from compare import duck, rows

import meshframe.plans.catalog as catalog
import meshframe.plans.dealt as dealt
import meshframe.plans.streams as streams

SF = "/root/testdata/sf0.001"
PARTS = [catalog, dealt, streams]
NAMES = ["fn_presence", "mk_nodes_geo", "mk_dup_edges_last", "mk_orphan_errors", "mk_autoid", "mk_multi_id", "mk_multi_id_missing", "mk_edge_guard", "mk_agg_errors", "mk_map_meta", "mk_agg_override", "mk_agg_concat", "mk_agg_meta", "lk_get_edges", "mu_add_node", "mu_removed_edges", "mu_added_before", "mu_removed_before", "so_union_edges", "nb_event_multiplicity", "sp_depths", "sp_paths", "sp_layers", "sp_chunked", "sp_waits_others", "sp_layering_completely", "sp_toward", "sh_connection_nodes", "pa_hops", "pa_weighted", "p3_found", "p3_edges", "p3_median", "p5_found", "p5_snapshots", "st_ingest"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    part = next(p for p in PARTS if name in p.QUERIES)
    df = part.QUERIES[name](spark, SF)
    r = duck(SF).execute(part.SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
