import pytest

from weaklabel.operators import metrics as mt


@pytest.fixture(scope="module")
def preds(spark):
    rows = [("a", "a"), ("a", "b"), ("a", "new1"), ("b", "b"), ("b", "b"), ("b", "a"),
            ("z", "new1"), ("z", "a"), ("y", "new2")]
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)],
                                 "doc_id bigint, truth string, prediction string")


@pytest.fixture(scope="module")
def existing(spark):
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, class_idx int")


def test_f1_existing(preds, existing):
    r = mt.f1_existing(preds, existing).first()
    assert (r.micro_f1, r.macro_f1) == (0.545, 0.356)


def test_new_label_metrics(preds, existing):
    r = mt.new_label_metrics(preds, existing).first()
    assert (r.precision, r.recall) == (0.667, 0.667)


def test_perfect_predictions(spark):
    p = spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], "doc_id bigint, truth string, prediction string")
    r = mt.accuracy_f1(p).first()
    assert (r.accuracy, r.micro_f1, r.macro_f1) == (1.0, 1.0, 1.0)


def test_rows_split(preds, existing):
    assert mt.existing_rows(preds, existing).count() == 6
    assert mt.removed_rows(preds, existing).count() == 3


def test_attach_truth_checks_the_numbers(spark, preds):
    truth = spark.createDataFrame([(i, "t") for i in range(9)], "doc_id bigint, label string")
    p = preds.select("doc_id", "prediction")
    assert mt.attach_truth(p, truth, check=True).select("truth").distinct().collect()[0].truth == "t"
    with pytest.raises(ValueError, match="9 predictions for 8 documents"):
        mt.attach_truth(p, truth.where("doc_id > 0"), check=True)
