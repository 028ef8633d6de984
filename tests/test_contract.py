"""The driver contract: entry smoke, registry consistency, scratch paths."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["window_id", "i", "j", "cooc_count", "count_i", "count_j", "norm_score", "npmi"]


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 200
    for name, text in s.items():
        assert text.strip(), name


def test_checkpoint_dir_is_shared_setting(spark):
    from tessera.session import ensure_checkpoint_dir, scratch_path
    base = ensure_checkpoint_dir(spark)
    assert scratch_path(spark, "x").startswith(base)
