"""Queries against their SQL on tables where scores tie in the digits their SQL ranks by."""

import pytest

from compare import connect

TIED = "/root/testdata/sf0.01"


def shown(columns, rows, order):
    at = [columns.index(c) for c in order]
    return {tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows}


@pytest.mark.parametrize("name", ["K8_oof_stitch"])
def test_ranks_by_the_digits_of_its_sql(spark, name):
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, TIED)
    sql = connect(TIED).execute(entry.oracle_sql()[name])
    assert shown(df.columns, df.collect(), df.columns) == shown([d[0] for d in sql.description], sql.fetchall(), df.columns)
