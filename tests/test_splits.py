import pytest
from pyspark.sql import functions as F

from foldstone import vocab as V
from foldstone.operators import splits as S
from foldstone.sources import tables as B
from foldstone.session import scratch_path


@pytest.fixture(scope="module")
def folds(inventory):
    return S.build_folds(inventory, "filename", "actor", "emotion_label", F.col("statement") == "01", F.col("statement") == "02").cache()


def sizes(folds, protocol, split="test"):
    rows = folds.where((F.col("protocol") == protocol) & (F.col("split") == split)).groupBy("fold").count().orderBy("fold").collect()
    return [r["count"] for r in rows]


def test_sizes(folds):
    assert folds.count() == 19440
    assert sorted(sizes(folds, "speaker_independent")) == [240, 300, 300, 300, 300]
    assert all(abs(n - 288) <= 8 for n in sizes(folds, "random_stratified"))
    assert sizes(folds, "statement_holdout") == [720] and sizes(folds, "statement_holdout", "train") == [720]
    assert sorted(sizes(folds, "statement_holdout_si")) == [120, 150, 150, 150, 150]


def test_no_group_on_both_sides(folds, inventory):
    table = S.summarise_folds(folds, inventory, "filename", "actor", "emotion_label", F.col("gender") == "male", ["neutral"])
    rows = {(r["protocol"], r["fold"]): r for r in table.collect()}
    for f in range(5):
        assert rows[("speaker_independent", f)]["group_overlap"] == 0
        assert rows[("statement_holdout_si", f)]["group_overlap"] == 0
        assert rows[("random_stratified", f)]["group_overlap"] == 24
    assert rows[("statement_holdout", 0)]["test_pct_attribute"] == 50.0
    assert sum(rows[("speaker_independent", f)]["test_neutral"] for f in range(5)) == 96


def test_each_row_is_tested_once(folds):
    for protocol in ("speaker_independent", "random_stratified"):
        once = folds.where((F.col("protocol") == protocol) & (F.col("split") == "test")).groupBy("filename").count()
        assert once.count() == 1440 and once.where("count <> 1").count() == 0


def test_labels_are_balanced(folds, inventory):
    cells = folds.where("protocol = 'random_stratified' AND split = 'test'").join(inventory, "filename").groupBy("emotion_label", "fold").count()
    spread = cells.groupBy("emotion_label").agg((F.max("count") - F.min("count")).alias("d")).agg(F.max("d")).first()[0]
    assert spread <= 1


def test_snake_and_greedy_keep_groups_whole(inventory):
    for method in ("snake", "greedy"):
        table = S.group_folds(inventory, "actor", 5, method)
        assert table.count() == 24 and table.select("fold").distinct().count() == 5


def test_freeze_and_write_once(spark, folds):
    path = scratch_path(spark, "frozen")
    B.write_folds(folds, path)
    with pytest.raises(Exception):
        B.write_folds(folds, path)
    B.write_folds(folds, path, force=True)
    stored = B.read_folds(spark, path)
    assert S.freeze_check(folds, stored).first().asDict() == {"added": 0, "missing": 0}
    changed = stored.where("filename <> '01-01-01-01-01.wav'")
    assert S.freeze_check(folds, changed).first()["added"] > 0
    with pytest.raises(FileNotFoundError):
        B.read_folds(spark, path + "-none")


def test_unknown_fold_or_protocol(inventory, folds):
    with pytest.raises(ValueError):
        S.get_split(inventory, folds, "speaker_independent", 7, "filename")
    with pytest.raises(ValueError):
        S.get_split(inventory, folds, "nope", 0, "filename")


@pytest.fixture(scope="module")
def merged(spark):
    rows = []
    shape = {"RAVDESS": (6, 16, 8), "CREMA-D": (12, 12, 6), "TESS": (2, 40, 7), "SAVEE": (4, 8, 7)}
    for source, (groups, per, labels) in shape.items():
        for g in range(groups):
            for i in range(per):
                rows.append((f"{source}-{g}-{i}.wav", source, f"{source}_{g}", V.LABELS[i % labels]))
    return spark.createDataFrame(rows, "filename string, source string, speaker_id string, emotion_label string").cache()


def test_merged_protocols(merged):
    assert merged.count() == 352
    folds = S.build_merged_folds(merged, "filename", "speaker_id", "emotion_label", order=V.SOURCES)
    held = folds.where("protocol = 'corpus_holdout' AND split = 'test'").join(merged, "filename")
    order = {r["fold"]: r["source"] for r in held.select("fold", "source").distinct().collect()}
    assert [order[i] for i in range(4)] == list(V.SOURCES)
    table = S.summarise_folds(folds, merged, "filename", "speaker_id", "emotion_label", F.lit(True), source="source")
    rows = {(r["protocol"], r["fold"]): r for r in table.collect()}
    assert all(rows[("corpus_holdout", f)]["source_overlap"] == 0 for f in range(4))
    assert all(rows[("speaker_independent_merged", f)]["group_overlap"] == 0 for f in range(5))


def base_folds(merged):
    base = merged.where("source = 'RAVDESS'")
    return S.long_table(S.with_group_fold(base, "speaker_id", 5), "speaker_independent", "filename", 5)


def test_added_sources_leave_the_test_side_alone(merged):
    folds = base_folds(merged)
    train, test = S.augmented_train(merged, folds, "speaker_independent", 0, "filename", ["TESS"], "RAVDESS")
    plain, same = S.augmented_train(merged, folds, "speaker_independent", 0, "filename", [], "RAVDESS")
    assert train.count() == plain.count() + 80
    assert {r[0] for r in test.select("filename").collect()} == {r[0] for r in same.select("filename").collect()}
    with pytest.raises(ValueError, match="always"):
        S.augmented_train(merged, folds, "speaker_independent", 0, "filename", ["RAVDESS"], "RAVDESS")
    with pytest.raises(ValueError, match="unknown"):
        S.augmented_train(merged, folds, "speaker_independent", 0, "filename", ["XX"], "RAVDESS")


def test_arms(merged):
    arms = S.arm_table(base_folds(merged), merged, "filename", "RAVDESS")
    rows = {(r["arm"], r["fold"]): r for r in S.arm_summary(arms).collect()}
    for f in range(5):
        tests = {rows[(a, f)]["test"] for a in V.ARMS}
        assert len(tests) == 1
        n = 96 - tests.pop()
        assert rows[("ravdess_only", f)]["stage2"] == n and rows[("ravdess_only", f)]["stage1"] == 0
        assert rows[("pooled", f)]["stage2"] == n + 256
        assert rows[("two_stage", f)]["stage1"] == rows[("two_stage_frozen", f)]["stage1"] == n + 256
        assert rows[("two_stage_frozen", f)]["freeze_backbone"]
    leaking = base_folds(merged).unionByName(
        merged.where("source = 'TESS'").limit(1).select(F.lit("speaker_independent").alias("protocol"), F.lit(0).alias("fold"), "filename", F.lit("test").alias("split"))
    )
    with pytest.raises(ValueError):
        S.arm_table(leaking, merged, "filename", "RAVDESS")


def test_nested_folds_stay_inside_the_train_side(inventory):
    outer = S.with_group_fold(inventory, "actor", 5)
    inner = S.nested_folds(outer, "actor", 3)
    both = inner.join(outer.select("actor", F.col("fold").alias("own")).distinct(), "actor")
    assert both.where("outer = own").count() == 0
    assert inner.groupBy("outer", "actor").count().where("count > 1").count() == 0


def test_default_folds_do_not_depend_on_the_number_of_groups(spark):
    small = spark.range(600).selectExpr("id as key", "id % 50 as grp")
    default = {r["grp"]: r["fold"] for r in S.group_folds(small, "grp", 5).collect()}
    snake = {r["grp"]: r["fold"] for r in S.snake_folds(small, "grp", 5).collect()}
    assert default == snake


def test_greedy_folds_equal_dealing_one_by_one(spark):
    import random

    from foldstone.operators import splits as S

    rng = random.Random(2)
    sizes = {g: rng.choice([1, 1, 1, 2, 3, 3, 7, 20]) for g in range(150)} | {500: 90, 501: 90}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "grp long")
    for k in (2, 5, 7):
        loads, want = [0] * k, {}
        for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            want[g] = loads.index(min(loads))
            loads[want[g]] += n
        assert {r["grp"]: r["fold"] for r in S.greedy_folds(df, "grp", k).collect()} == want


def test_water_level():
    from foldstone.operators import splits as S

    for start, size, m in (([0, 0, 0], 4, 7), ([9, 1, 5], 2, 3), ([9, 1, 5], 2, 0), ([3, 3, 10], 5, 1)):
        loads = list(start)
        for _ in range(m):
            loads[loads.index(min(loads))] += size
        assert S._water_level(start, size, m) == loads


def test_places_of_rows_say_what_the_long_table_says(spark):
    rows = [(i, None if i % 11 == 0 else f"g{i % 7}", "abc"[i % 3], bool(i % 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "key long, grp string, label string, early boolean")
    for method in ("snake", "greedy"):
        args = (df, "key", "grp", "label", F.col("early"), ~F.col("early"))
        long, assigned = S.build_folds(*args, method=method), S.assigned_folds(*args, method=method)
        if method == "greedy":  # rows without group stay in the protocols without groups
            n = {r["protocol"]: r["n"] for r in long.groupBy("protocol").agg(F.count_distinct("key").alias("n")).collect()}
            assert n["random_stratified"] == 150 and n["speaker_independent"] == 136
        want = long.join(df, "key").groupBy("protocol", "fold", "split", "label").count().collect()
        got = S.protocol_counts(assigned, ["label"]).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        meta = df.withColumn("source", F.concat("label", F.lit("_src")))
        odd = F.col("key") % 2 == 1
        want = S.summarise_folds(long, meta, "key", "grp", "label", odd, ["a"], "source")
        got = S.summarise_protocols(assigned.withColumn("source", F.concat("label", F.lit("_src"))), "grp", "label", odd, ["a"], "source")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        # counts and groups come from rows that were not repeated for their folds
        plan = S.protocol_counts(assigned, ["label"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Window")


def test_frozen_places_are_compared(spark):
    df = spark.createDataFrame([(i, i % 7, "abc"[i % 3], bool(i % 2)) for i in range(60)], "key long, grp long, label string, early boolean")
    one = S.assigned_folds(df, "key", "grp", "label", F.col("early"), ~F.col("early"))
    moved = one.withColumn("_own", F.when(F.col("key") == 5, (F.col("_own") + 1) % 5).otherwise(F.col("_own")))
    assert S.freeze_check_assigned(one, one.repartition(3, "key"), "key").first().asDict() == {"added": 0, "missing": 0}
    for a, b in ((one, moved), (moved, one), (one, one.where("key <> 9")), (one.union(one), one)):
        assert S.freeze_check_assigned(a, b, "key").first() == S.freeze_check(S.protocol_rows(a, ["key"]), S.protocol_rows(b, ["key"])).first()
    assert S.freeze_check_assigned(one, moved, "key").first()["added"] > 0
