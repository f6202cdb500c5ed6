import __spark_entry__ as entry


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert len(rows) > 5 and [r["rank"] for r in sorted(rows, key=lambda r: (-r.score, -r.n_files, r.cluster_id))] == list(range(1, len(rows) + 1))
    assert all(r.n_files >= 2 and r.name and r.preview for r in rows)
