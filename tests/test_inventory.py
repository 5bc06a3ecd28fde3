import pytest
from pyspark.sql import functions as F

from foldstone import vocab as V
from foldstone.operators import inventory as I


def parse(spark, *paths):
    return I.parse_base(spark.createDataFrame([(p,) for p in paths], "path string"))


def test_complete_inventory_is_valid(inventory):
    assert inventory.count() == V.EXPECTED_ROWS
    assert I.base_problems(inventory).count() == 0
    I.require_valid(I.base_problems(inventory))


@pytest.mark.parametrize(
    "path, reason",
    [
        ("/d/Person01/01-01-01-01.wav", "field count"),
        ("/d/Person01/03-01-01-01-01-01-01.wav", "field count"),
        ("/d/Person01/09-01-01-01-01.wav", "unknown emotion"),
        ("/d/Person01/02-03-01-01-01.wav", "unknown intensity"),
        ("/d/Person25/02-01-01-01-25.wav", "actor"),
        ("/d/Person01/02-01-01-01-1.wav", "actor"),
        ("/d/Person03/02-01-01-01-04.wav", "directory"),
    ],
)
def test_bad_names(spark, path, reason):
    rows = parse(spark, path)
    assert [r["problem"] for r in rows.collect()] == [reason]
    with pytest.raises(Exception, match=reason):
        I.strict(rows).collect()


def test_directory_only_checked_when_it_names_a_person(spark):
    assert parse(spark, "/d/other/02-01-01-01-04.wav").first()["problem"] is None


def test_all_faults_are_reported_together(inventory):
    broken = inventory.where("filename <> '01-01-01-01-01.wav'").withColumn(
        "gender", F.when(F.col("actor") == 3, "female").otherwise(F.col("gender"))
    )
    names = {r["check"] for r in I.base_problems(broken).collect()}
    assert {"row count", "rows per group", "rows per label", "groups per attribute", "derived attribute"} <= names
    with pytest.raises(ValueError, match="row count"):
        I.require_valid(I.base_problems(broken))


def test_other_parsers(spark):
    demo = spark.createDataFrame([(1001, "Male")], "ActorID int, Sex string")
    files = spark.createDataFrame([("a/1001_DFA_ANG_XX.wav",), ("a/1002_IEO_HAP_HI.wav",), ("a/1001_DFA_ZZZ_XX.wav",)], "path string")
    rows = {r["filename"]: r for r in I.parse_cremad(files, demo).collect()}
    assert rows["1001_DFA_ANG_XX.wav"]["gender"] == "male"
    assert rows["1001_DFA_ANG_XX.wav"]["label_idx"] == 4
    assert rows["1002_IEO_HAP_HI.wav"]["gender"] == "unknown"
    assert rows["1002_IEO_HAP_HI.wav"]["intensity_label"] == "high"
    assert rows["1001_DFA_ZZZ_XX.wav"]["problem"] == "unknown emotion"
    tess = I.parse_tess(spark.createDataFrame([("t/OA_bite_neutral.wav",), ("t/YAF_dog_ps.wav",)], "path string")).orderBy("filename").collect()
    assert [r["speaker_id"] for r in tess] == ["TESS_OAF", "TESS_YAF"]
    assert [r["emotion_label"] for r in tess] == ["neutral", "surprised"]
    paths = [("s/DC_a01.wav",), ("s/DC/sa01.wav",), ("s/JK/su12.wav",), ("s/none/a01.wav",), ("s/DC_x01.wav",)]
    savee = {r["filepath"]: r for r in I.parse_savee(spark.createDataFrame(paths, "path string")).collect()}
    assert savee["s/DC_a01.wav"]["emotion_label"] == "angry"
    assert savee["s/DC/sa01.wav"]["emotion_label"] == "sad"
    assert savee["s/JK/su12.wav"]["emotion_label"] == "surprised"
    assert savee["s/none/a01.wav"]["problem"] == "speaker"
    assert savee["s/DC_x01.wav"]["problem"] == "name"


def test_vocabularies_are_closed():
    for table in (V.CREMAD_EMOTION, V.TESS_EMOTION, V.SAVEE_EMOTION):
        assert I.unknown_values(table, V.LABELS) == []
    assert I.unknown_values({"x": "bored"}, V.LABELS) == ["bored"]


def test_merged_index_faults(spark, inventory):
    index = I.base_index(inventory.withColumn("problem", F.lit(None).cast("string"))).drop("problem")
    assert I.index_problems(index).count() == 0
    bad = index.withColumn("emotion_label", F.when(F.col("filename") == "02-01-01-01-01.wav", "bored").otherwise(F.col("emotion_label")))
    bad = bad.withColumn("label_idx", F.when(F.col("filename") == "03-01-01-01-01.wav", 99).otherwise(F.col("label_idx")))
    bad = bad.unionByName(index.limit(1).withColumn("source", F.lit("TESS")))
    found = {r["check"] for r in I.index_problems(bad).collect()}
    assert {"stray label", "label index drift", "duplicate paths", "shared keys", "group spans sources", "published count"} <= found


def test_empty_source_keeps_schema(spark):
    empty = I.empty_index(spark)
    assert empty.columns == list(V.INDEX_COLUMNS) and empty.count() == 0
