from pyspark.sql import functions as F

from fairground import session
from fairground.session import cut_lineage


def _plan_cleans_up(df):
    return df._jdf.queryExecution().shuffleCleanupMode().toString()


def test_cut_lineage_leaves_no_shuffle_files(spark, monkeypatch):
    seen = []
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    checkpoint = type(counts).checkpoint
    monkeypatch.setattr(type(counts), "checkpoint", lambda df, **how: seen.append(_plan_cleans_up(df)) or checkpoint(df, **how))
    cut = cut_lineage(counts)
    assert sorted(cut.collect()) == sorted(counts.collect())
    assert "Remove" in seen[0]  # the frame that is stored, not its owner's
    assert "Remove" not in _plan_cleans_up(counts)
    assert spark.conf.get(session._CLEAN_UP) == "false"


def test_cut_lineage_keeps_a_session_setting(spark):
    spark.conf.set(session._CLEAN_UP, "true")
    try:
        assert cut_lineage(spark.range(10).distinct()).count() == 10
        assert spark.conf.get(session._CLEAN_UP) == "true"
    finally:
        spark.conf.unset(session._CLEAN_UP)
