"""Cleaning, validation, ordering, maintenance, files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import autoprep, cleaning, encoding, maintenance, ordering, splitting, validation
from churnlake.session import work_path
from churnlake.sources import files


@pytest.fixture
def raw(spark):
    rows = [("C1", " Female ", "2", "80", "160", "Yes"), ("C1", " Female ", "2", "80", "160", "Yes"),
            ("C2", "Male", "x", "50", " ", "No"), ("C3", "male", "30", "20", "abc", "maybe"), ("C4", None, "5", "", "400", "1")]
    return spark.createDataFrame(rows, "customerID string, gender string, tenure string, MonthlyCharges string, "
                                       "TotalCharges string, Churn string")


def test_clean(raw):
    rows = {r.customerID: r for r in cleaning.clean_customers(raw).collect()}
    assert len(rows) == 4
    assert rows["C2"].TotalCharges == rows["C3"].TotalCharges == 280.0      # median of 160 and 400
    assert rows["C2"].tenure == 0.0 and rows["C4"].MonthlyCharges == 0.0 and rows["C1"].gender == "Female"
    assert {k: r.Churn for k, r in rows.items()} == {"C1": 1, "C2": 0, "C3": 0, "C4": 1}


def test_clean_without_total_charges(raw):
    assert {r.TotalCharges for r in cleaning.clean_customers(raw.drop("TotalCharges")).collect()} == {0.0}


def test_scoring_keeps_duplicates(raw):
    assert cleaning.clean_customers(raw, drop_duplicates=False, charges_median=1.0).count() == 5


def test_duplicate_report(raw):
    assert tuple(cleaning.duplicate_report(raw).first()) == (5, 4, 1)


def test_nan_text_is_null(spark):
    df = spark.createDataFrame([("NaN",), ("1.5",), ("",)], "x string")
    assert [r[0] for r in df.select(cleaning.number(F.col("x"))).collect()] == [None, 1.5, None]


def test_binary_encode_skips_numbers(spark):
    df = spark.createDataFrame([("FEMALE", "Yes", 1), ("Male", None, 0)], "gender string, Partner string, Dependents int")
    assert [tuple(r) for r in cleaning.binary_encode(df).collect()] == [(1, 1, 1), (0, 0, 0)]


def test_canonical_keeps_existing(spark):
    df = spark.createDataFrame([(1, 2)], "monthly_charges int, MonthlyCharges int")
    assert cleaning.canonical_columns(df).columns == ["monthly_charges", "MonthlyCharges"]


def test_validation(spark):
    rows = [("1", "20.12345", "One year", "Mailed check", "", "Gold"), ("-4", "-1", "Never", None, "x", None)]
    df = spark.createDataFrame(rows, "tenure string, monthly_charges string, contract string, payment_method string, "
                                     "total_charges string, subscription_type string")
    good, bad = validation.validate_customers(df).collect()
    assert good.reasons == [] and good.MonthlyCharges == 20.1234 and good.TotalCharges == 20.1234
    assert good.SubscriptionType == "Standard" and good.InternetService == "DSL" and good.Partner == "No"
    assert bad.tenure == 0 and bad.reasons == [
        "missing payment_method", "monthly_charges must be a non-negative number", "contract is not allowed",
        "total_charges must be a number"]


def test_users(spark):
    df = spark.createDataFrame([(" Al ", "A@b.CO", "ADMIN"), ("x", "a b@c", "boss")], "name string, email string, role string")
    good, bad = validation.validate_users(df).collect()
    assert (good.email, good.role, good.reasons) == ("a@b.co", "admin", []) and bad.role == "viewer" and len(bad.reasons) == 2


def test_exact_quantiles(spark):
    """Quantiles equal those of the sorted list; one key holds most rows."""
    draw = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 4}", float(draw.randint(0, 400)) if i % 2 else draw.random() * 300,
             None if i % 10 == 0 else float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(6)
    found = ordering.exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.99, 1.0], ["k"]).collect()
    assert len(found) == len({r[0] for r in rows}) * 10
    for r in found:
        values = [x[1] if r.metric == "a" else x[2] for x in rows if x[0] == r.k]
        assert r.value == pytest.approx(np.quantile([v for v in values if v is not None], r.probability), rel=1e-12)


def test_row_numbers_and_pages(spark, monkeypatch):
    df = spark.range(500).withColumn("x", (F.col("id") * 37) % 101)
    order = [F.desc("x"), F.col("id")]
    expected = [r.id for r in df.orderBy(*order).collect()]
    numbered = ordering.with_row_number(df.repartition(7), order).collect()
    assert [r.id for r in sorted(numbered, key=lambda r: r.row_number)] == expected
    assert sorted(r.row_number for r in numbered) == list(range(1, 501))
    assert [r.id for r in ordering.page_rows(df, order, 3, 20).collect()] == expected[40:60]


def test_page_info(spark):
    assert tuple(ordering.page_info(spark.range(41), 2, 20).first()) == (41, 2, 20, 3, True, True)
    assert tuple(ordering.page_info(spark.range(0), 0, 900).first()) == (0, 1, 200, 1, False, False)


def test_split(customers):
    split = splitting.stratified_split(customers)
    counts = {(r.Churn, r.split): r["count"] for r in split.groupBy("Churn", "split").count().collect()}
    for label in (0, 1):
        share = counts[label, "test"] / (counts[label, "test"] + counts[label, "train"])
        assert share == pytest.approx(0.2, abs=0.03)
    again = splitting.stratified_split(customers.repartition(5))
    assert split.select("customerID", "split").exceptAll(again.select("customerID", "split")).isEmpty()


def test_encoder_fit_and_unseen(spark):
    rows = [(1.0, "a"), (3.0, "b"), (None, None), (4.0, "c")]
    df = spark.createDataFrame(rows, "tenure double, Contract string")
    encoder = encoding.fit_encoder(df)
    assert encoder.medians == {"tenure": 3.0} and encoder.feature_names == ["tenure", "Contract_a", "Contract_b", "Contract_c"]
    assert [r.word for r in encoder.vocabulary.table.orderBy("word").collect()] == ["Missing", "a", "b", "c"]
    filled = [1.0, 3.0, 3.0, 4.0]
    assert encoder.means["tenure"] == pytest.approx(np.mean(filled))
    assert encoder.deviations["tenure"] == pytest.approx(np.std(filled))
    new = spark.createDataFrame([(None, "zzz")], df.schema)
    assert encoder.matrix(new).first().features.toArray()[1:].tolist() == [0.0, 0.0, 0.0]


def test_auto_prepare(spark):
    rows = [(i, f"id{i}", "yes" if i % 3 == 0 else "No", None if i % 5 == 0 else float(i % 4), ["u", "v"][i % 2] if i % 7 else None,
             i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, name string, Has_Churned string, x double, word string, flag boolean")
    ready = autoprep.auto_prepare(df)
    assert ready.target == "Has_Churned" and sorted(ready.dropped) == ["n", "name"]
    assert ready.features == ["x", "flag", "word_v"]
    assert ready.data.agg(F.sum("Has_Churned")).first()[0] == 20


def test_find_target():
    assert autoprep.find_target(["a", "CHURN", "churned"]) == "CHURN"
    assert autoprep.find_target(["a", "my_churn_flag"]) == "my_churn_flag"
    assert autoprep.find_target(["Exited", "label"]) == "label"
    with pytest.raises(ValueError):
        autoprep.find_target(["a", "b"])


def test_maintenance(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "k int, name string, x int")
    changes = spark.createDataFrame([(1, "z", False, None, True), (2, "y", True, 5, False)],
                                    "k int, name string, set_name boolean, x int, set_x boolean")
    updated = maintenance.update_by_key(table, changes, "k", ["name", "x"]).orderBy("k").collect()
    assert [tuple(r) for r in updated] == [(1, "a", None), (2, "y", 20), (3, "c", 30)]
    ignored = maintenance.update_by_key(table, changes, "k", ["other"]).orderBy("k").collect()
    assert [tuple(r) for r in ignored] == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    new = spark.createDataFrame([(2, "q", 1), (2, "r", 2)], table.schema)
    replaced = maintenance.replace_by_key(table, new, "k").collect()
    assert sorted(tuple(r) for r in replaced) == [(1, "a", 10), (2, "q", 1), (2, "r", 2), (3, "c", 30)]
    doomed = spark.createDataFrame([(1,), (1,)], "k int")
    assert sorted(r.k for r in maintenance.delete_by_key(table, doomed, ["k"]).collect()) == [2, 3]
    assert sorted((r.k or 0, r.x) for r in maintenance.set_null_by_key(table, doomed, "k").collect()) == [(0, 10), (2, 20), (3, 30)]
    more = spark.createDataFrame([(9, "n", 2), (9, "m", 1), (1, "a", 0)], table.schema)
    added = maintenance.insert_if_absent(table, more, "k", ["x"]).where("k = 9").collect()
    assert [tuple(r) for r in added] == [(9, "m", 1)]
    ids = maintenance.with_new_ids(new.drop("k"), table, "k", [F.col("x")]).orderBy("x").collect()
    assert [r.k for r in ids] == [4, 5]


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("tenure,monthly_charges,contract,extra\n3,20.5,One year,q\n,x,Two year,w\n")
    raw = files.read_raw_customers(spark, str(path))
    assert {f.dataType.typeName() for f in raw.schema} == {"string"} and raw.count() == 2
    scoring = files.read_scoring_csv(spark, str(path), max_rows=2)
    assert dict(scoring.dtypes) == {"tenure": "int", "monthly_charges": "double", "contract": "string", "extra": "string"}
    with pytest.raises(ValueError):
        files.read_scoring_csv(spark, str(path), max_rows=1)
    with pytest.raises(FileNotFoundError):
        files.read_raw_customers(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        files.read_training_csv(spark, str(path))
    empty = tmp_path / "e.csv"
    empty.write_text("tenure,contract\n")
    with pytest.raises(ValueError):
        files.read_scoring_csv(spark, str(empty))


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_training_csv_encodings(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(("city,churn\n" + "Zürich,1\n" * 60).encode(encoding))
    df = files.read_training_csv(spark, str(path))
    assert {r.city for r in df.collect()} == {"Zürich"} and dict(df.dtypes)["churn"] == "int"


def test_report_and_append(spark):
    base = work_path(spark, "test")
    files.write_report(spark.sql("SELECT 1 AS a, cast(null AS int) AS b, array(struct(2 AS c)) AS d"), f"{base}/report")
    assert spark.read.text(f"{base}/report").first()[0] == '{"a":1,"b":null,"d":[{"c":2}]}'
    point = spark.sql("SELECT 'm' AS metric_name, 1 AS metric_value")
    files.append_rows(point, base, "metrics")
    files.append_rows(point, base, "metrics")
    assert files.read_table(spark, base, "metrics").count() == 2


def test_numbers_of_any_kind(spark, tmp_path):
    """Decimals in a scoring CSV, values beyond an int, and double-typed columns keep their value or become null."""
    from churnlake.operators import cleaning, validation
    from churnlake.sources import files
    path = str(tmp_path / "scoring.csv")
    with open(path, "w") as out:
        out.write("customerID,tenure,MonthlyCharges,InactiveDays,SeniorCitizen\na,3.0,70.0,12.0,0\nb,x,1e400,,1\n")
    a, b = sorted(files.read_scoring_csv(spark, path).collect(), key=lambda r: r.customerID)
    assert (a.tenure, a.MonthlyCharges, a.InactiveDays) == (3, 70.0, 12) and b.tenure is None and b.InactiveDays is None
    assert {r["column"]: r["unreadable"] for r in files.unreadable_values(spark, path).collect()}["tenure"] == 1
    big = spark.createDataFrame([("a", 1e12, "5", 10.0)], "customerID string, SeniorCitizen double, TotalCharges string, tenure double")
    assert cleaning.clean_customers(big, charges_median=0.0).first().SeniorCitizen == 0
    typed = spark.createDataFrame([(12.0, 45.0, 50.0, "One year", "Mailed check")],
                                  "tenure double, InactiveDays double, MonthlyCharges double, Contract string, PaymentMethod string")
    row = validation.validate_customers(typed).first()
    assert (row.tenure, row.InactiveDays, row.TotalCharges, row.reasons) == (12, 45, 600.0, [])


