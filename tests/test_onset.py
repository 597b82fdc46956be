import datetime as dt

from pyspark.sql import functions as F

from cohortline.operators import incidence, lineage, onset as O

D = dt.date


def by_id(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select("subject_id", *cols).collect()}


def panel(spark, rows):
    return spark.createDataFrame(rows, "subject_id string, week int, rbg double")


def test_crossing_is_strict_and_never_is_80(spark):
    meas = panel(spark, [("a", 4, 200.0), ("a", 8, 201.0), ("b", 4, 150.0), ("c", 4, None)])
    subjects = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "subject_id string")
    got = by_id(O.onset_table(subjects, meas), "rbg100", "rbg200", "rbg300")
    assert got == {"a": (4, 8, 80), "b": (4, 80, 80), "c": (80, 80, 80), "d": (80, 80, 80)}
    first = O.first_reading_above(meas, 100).collect()
    assert {(r.subject_id, r.week) for r in first} == {("a", 4), ("b", 4)}


def subject(spark, rows):
    return spark.createDataFrame(rows, "subject_id string, sex string, birth_date date, death_date date, rbg200 int")


def test_event_time(spark):
    onset = subject(spark, [
        ("onset", "M", D(2020, 1, 1), None, 12), ("died", "M", D(2020, 1, 1), D(2020, 3, 1), 80),
        ("alive", "F", D(2020, 1, 1), None, 80), ("unseen", "F", D(2020, 1, 1), None, 80)])
    meas = panel(spark, [("alive", 4, 1.0), ("alive", 20, 1.0), ("onset", 12, 250.0)])
    got = by_id(O.event_table(onset, meas), "event", "event_time")
    # 60 days are 8.57 weeks, minus 4, rounded
    assert got == {"onset": (1, 8), "died": (0, 5), "alive": (0, 16), "unseen": (0, None)}


def test_eligibility_strict_and_as_recorded(spark):
    onset = subject(spark, [
        ("early", "M", D(2020, 1, 1), D(2020, 2, 1), 8), ("short", "M", D(2020, 1, 1), D(2020, 2, 1), 80),
        ("long", "F", D(2020, 1, 1), D(2021, 2, 1), 80), ("unknown", "F", D(2020, 1, 1), None, 80)])
    cut = {"M": 16, "F": 36}
    assert set(by_id(O.eligible(onset, cut))) == {"early", "long"}
    assert set(by_id(O.eligible(onset, cut, strict=False))) == {"early", "short", "long", "unknown"}
    groups = by_id(O.onset_groups(onset, cut), "onset_group")
    assert groups == {"early": ("onset",), "long": ("no onset",)}


def test_siblings_share_the_mother_only(spark):
    rows = [("a", "m1", "f1", "M", 4), ("b", "m1", "f1", "M", 80), ("half", "m2", "f1", "M", 80),
            ("n1", None, "f1", "M", 4), ("n2", None, "f1", "M", 80), ("only", "m3", None, "F", 4)]
    df = spark.createDataFrame(rows, "subject_id string, mother string, father string, sex string, rbg200 int")
    got = by_id(lineage.sibling_onset(df, {"M": 16, "F": 36}), "rbg200_sib")
    assert got == {"a": (0,), "b": (1,), "half": (0,), "n1": (0,), "n2": (0,), "only": (0,)}


def test_parents_by_the_cutoff_of_their_sex(spark):
    onset = spark.createDataFrame([("mo", "F", 30), ("fa", "M", 30), ("kid", "M", 80), ("orphan", "M", 80)],
                                  "subject_id string, sex string, rbg200 int")
    kids = spark.createDataFrame([("kid", "mo", "fa", "M", 80), ("orphan", "gone", None, "M", 80)],
                                 "subject_id string, mother string, father string, sex string, rbg200 int")
    got = by_id(lineage.lineage_features(kids, onset, {"M": 16, "F": 36}), "rbg200_mo", "rbg200_fa", "rbg200_sib", "family_history")
    assert got == {"kid": (True, False, 0, True), "orphan": (False, False, 0, False)}


def test_incidence(spark):
    rows = [(str(i), "M", w) for i, w in enumerate([4, 8, 8, 44])]
    df = spark.createDataFrame(rows, "subject_id string, sex string, rbg200 int")
    got = sorted(tuple(r) for r in incidence.cumulative_incidence(df).collect())
    assert got == [("M", 4, 1, 1, 25.0), ("M", 8, 2, 3, 75.0), ("M", 80, 1, 4, 100.0)]


def test_band_is_zero_where_all_or_none_are_free(spark):
    survival = spark.createDataFrame([("M", 8, 100.0, 50.0)], "sex string, rbg200 int, Rod double, Rab double")
    sizes = spark.createDataFrame([("M", 100)], "sex string, n int")
    got = {r.nursing: (r.lower, r.upper) for r in incidence.binomial_band(survival, sizes).collect()}
    assert got["Rod"] == (100.0, 100.0) and abs(got["Rab"][1] - 59.8) < 1e-9


def test_onset_counts(spark):
    df = spark.createDataFrame([("a", "Rod", 8), ("b", "Rod", 8), ("c", "Rab", 4)], "subject_id string, diet string, rbg200 int")
    assert [tuple(r) for r in O.onset_counts_by(df, 8, "diet").collect()] == [("Rod", 2)]
    assert df.filter(F.col("rbg200") == 8).count() == 2
