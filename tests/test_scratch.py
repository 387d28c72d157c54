"""Scratch tables go when their job is done."""

import os

from newsweave.plans import feeds as P
from newsweave.session import cut_lineage, scratch_removed, shared_dir
from newsweave.sources import sample as S


def test_scratch_tables_are_removed(spark, sf, tmp_path):
    kept = cut_lineage(spark.range(5))
    before = set(os.listdir(shared_dir(spark)))
    with scratch_removed(spark):
        P.personalized_digest(S.tables(spark, sf), limit=3).select("user_id", "position", "id").write.parquet(str(tmp_path / "digest"))
        assert set(os.listdir(shared_dir(spark))) > before
    assert set(os.listdir(shared_dir(spark))) == before and kept.count() == 5
    assert spark.read.parquet(str(tmp_path / "digest")).count() > 0
