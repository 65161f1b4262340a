from __future__ import annotations

from scriptorium.streaming import landing


def test_landed_files_are_scored_once(spark, tmp_path):
    spark.createDataFrame([(1, "Un texto corto. Otro más."), (2, " ")], landing.SCHEMA).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        landing.into_history(landing.scored(landing.landing(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
