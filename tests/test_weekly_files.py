import os

from conftest import frames, rows

from routeforge.sources import files


def test_weeks_are_written_in_one_pass(spark, tmp_path):
    data = frames(spark, [(k, f, k, f, {"week": k % 3 if k else None}) for k in range(7) for f in range(3)])
    sc = spark.sparkContext
    sc.setJobGroup("weekly", "weekly")
    try:
        files.write_tracking(data, str(tmp_path))
        files.write_tracking(data, str(tmp_path))  # over the first ones
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("weekly")) == 2
    assert sorted(os.listdir(tmp_path)) == [f"tracking_week_{k}.csv" for k in range(3)]
    back = files.read_tracking(spark, str(tmp_path))
    assert rows(back) == rows(data.where("week IS NOT NULL").select(back.columns))
