import os

import pytest

SF = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_registered():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    from loomgraph.plans import star_queries

    db = duckdb.connect()
    for t in os.listdir(SF):
        db.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")
    for name in ("impact_rank", "fts_top20", "ref_resolve", "cochange_mine", "context_expand", "edit_findings"):
        mine = star_queries.QUERIES[name](spark, SF)
        cols = sorted(mine.columns)
        found = db.sql(star_queries.SQL[name])
        theirs = [dict(zip(found.columns, r)) for r in found.fetchall()]
        key = lambda r: tuple(str(r[c]) for c in cols)
        assert sorted(map(key, (r.asDict() for r in mine.collect()))) == sorted(map(key, theirs)), name
