"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
# These cut groups, so they also run with a handful of rows per chunk.
ORDERED = ["c02_nested_steps", "c12_lookup_segment", "e01_select_reference", "e02_speaker_turns", "e03_speech_segments",
           "e05_pack_blocks", "e07_assign_batches", "e10_moving_power", "e21_concat_offsets", "f05_longest_first"]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in ORACLE:
        assert compare(df, duck, ORACLE[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ORDERED)
def test_query_on_cut_groups(spark, duck, chunked, name):
    with chunked(9):
        assert compare(entry.queries()[name](spark, FOLDER), duck, ORACLE[name]) is None


def test_entry_is_the_dashboard(spark):
    assert entry.entry(spark).count() == 50


def test_commands_of_projects_without_a_phase(spark, folder):
    import duckdb

    con = duckdb.connect()
    # o_custkey 12 has no phase; event 40 restarts from init, 31 without a phase (init), 22 from complete (refused), 13 from recomposing.
    con.execute(f"""COPY (SELECT * REPLACE (12 AS o_custkey, row_number() OVER () AS o_orderkey) FROM '{FOLDER}/orders.parquet' LIMIT 6)
      TO '{folder}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT e.* REPLACE (n.event_id AS event_id, n.user_id AS user_id) FROM (SELECT * FROM '{FOLDER}/events.parquet' LIMIT 1) e,
      (VALUES (40, 1), (31, 2), (22, 3), (13, 4), (5, 5), (40, 5)) n(event_id, user_id)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    for name in ("orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    df = entry.queries()["i03_apply_commands"](spark, folder)
    assert compare(df, con, ORACLE["i03_apply_commands"]) is None
    assert {r.task_id: r.phase for r in df.collect()} == {1: None, 2: None, 3: None, 4: "recomposing", 5: None, 6: None}
