from tracewise.plans import learn_queries as q

SF = "/root/testdata/sf0.01"


def test_binary_fit_sees_two_classes(spark):
    n = q.binary_label_counts(spark, SF).first()
    assert min(n.train_positive, n.train_negative, n.test_positive, n.test_negative) > 0 and n.pos_weight > 1
    r = q.binary_model_report(spark, SF).first().asDict()
    assert all(v is not None for k, v in r.items() if "auc" in k) and 0 <= r["accuracy"] <= 1
