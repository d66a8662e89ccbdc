def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(spark_df, duck_result):
    """Equal rows, whatever their order, with columns by name."""
    names = [d[0] for d in duck_result.description]
    assert sorted(spark_df.columns) == sorted(names)
    cols = sorted(names)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in spark_df.collect())
    b = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in duck_result.fetchall())
    assert a == b
