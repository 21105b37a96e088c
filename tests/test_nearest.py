from labelweave.operators import joins


def test_nearest_step_looks_at_two_before_and_three_from_there_on(spark):
    # 1, 2 fit the third step at or after their time and the second before it; 3 fits only the fourth and the third
    left = spark.createDataFrame([(1, 1, 100, 9), (2, 1, 100, 5), (3, 1, 100, 7)], "id long, day long, ms long, host long")
    hosts = [7, 5, 0, 0, 0, 9, 7]
    right = spark.createDataFrame([(10 + i, 1, ms, h) for i, (ms, h) in enumerate(zip((70, 80, 90, 100, 110, 120, 130), hosts))], "step long, day long, step_ms long, host long")
    got = {(r["id"], r["step"], r["delta_ms"]) for r in joins.nearest(left, right, ["day"], 2, 1000).collect()}
    assert got == {(1, 15, 20), (2, 11, 20)}
