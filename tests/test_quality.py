import pytest
from pyspark.sql import functions as F

from shopgroups.operators import quality as Q


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Bsc. A", "female", 1.0, 10.0), (1, "B", None, None, -2.0), (None, "Phd. C", "male", 1.0, 30.0),
            (None, " Msc. D", "female", None, None)]
    return spark.createDataFrame(rows, "id long, name string, gender string, card double, spend double")


def test_key_integrity_counts_null_as_value(people):
    got = dict((r.check, r.value) for r in Q.key_integrity(people, "id").collect())
    # ids 1, 1, NULL, NULL: distinct values {1, NULL}; repeats = 4 - 2
    assert got["duplicated id count"] == "2"
    assert got["unique id count"] == "2"
    assert got["id is unique"] == "false"
    assert got["duplicated row count"] == "0"


def test_missing_and_value_counts(people):
    miss = {r.column: (r.missing_count, r.missing_percentage) for r in Q.missing_summary(people).collect()}
    assert miss["gender"] == (1, 25.0) and miss["card"] == (2, 50.0)
    vc = {r.gender: r["count"] for r in Q.value_counts(people, "gender").collect()}
    assert vc == {"female": 2, "male": 1, None: 1}
    top = Q.value_counts(people, "gender", n=1).collect()
    assert top[0].gender == "female"


def test_prefix_presence_and_rules(people):
    prefixes = {r.prefix: r["count"] for r in Q.name_prefix_counts(people, "name").collect()}
    assert prefixes == {"Bsc.": 1, "Phd.": 1, "No visible prefix": 2}  # leading space hides the prefix
    presence = {r.status: r["count"] for r in Q.presence_counts(people, "card").collect()}
    assert presence == {"Present": 2, "Missing": 2}
    rules = {r.check: r["count"] for r in Q.rule_violations(people, [("negative spend", F.col("spend") < 0)]).collect()}
    assert rules == {"negative spend": 1}  # NULL never violates


def test_describe_and_histogram(people):
    desc = {r.column: r for r in Q.describe_numeric(people, ["spend"]).collect()}["spend"]
    assert desc["count"] == 3 and desc.p50 == 10.0 and desc.min == -2.0 and desc.max == 30.0
    assert desc.std == pytest.approx(16.165807537309522)
    hist = {r.bin: r["count"] for r in Q.histogram(people, "spend", bins=4).collect()}
    assert hist == {0: 1, 1: 1, 3: 1}  # last edge inclusive
    text = {r.column: r for r in Q.describe_text(people, ["gender"]).collect()}["gender"]
    assert (text["count"], text.unique, text.top, text.freq) == (3, 2, "female", 2)
