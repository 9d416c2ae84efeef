"""Joins whose tasks neither sort both sides nor hold positions spelled out one by one."""

from fieldgrain.plans.frames import examples


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_meet_a_hash_table_of_orders(spark, sf_dir):
    plan = plan_of(examples(spark, sf_dir))
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_center_members_meet_their_pixels(spark):
    from fieldgrain.operators.patches import center_members

    pixels = spark.createDataFrame([(s, z, x, z * 100 + x) for s in (1, 2) for z in range(12) for x in range(10)], "sample_id long, iz int, ix int, v int")
    at = [(1, 0, 0), (1, 5, 4), (1, 5, 5), (1, 5, 5), (1, 11, 9), (2, 6, 7), (2, 30, 3), (3, 5, 5)]
    centers = spark.createDataFrame(at, "sample_id long, cz int, cx int")
    for window in (1, 3, 4, 9):
        half = window // 2
        want = sorted(
            (s, z, x, cz, cx, z * 100 + x) for s, cz, cx in at if s < 3
            for z in range(max(0, cz - half), min(11, cz + half) + 1) for x in range(max(0, cx - half), min(9, cx + half) + 1)
        )
        got = center_members(pixels, centers, window)
        assert got.columns == ["sample_id", "iz", "ix", "cz", "cx", "v"]
        assert sorted(map(tuple, got.collect())) == want


def test_centers_are_not_spelled_out_by_position(spark, sf_dir):
    from fieldgrain.plans import load_queries

    plan = plan_of(load_queries()["explicit_center_members"].build(spark, sf_dir))
    assert "ShuffledHashJoin [sample_id" in plan and "_tz" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan
