"""Best outlet / product (L6) and the profile report lines."""

from storeline.operators import enrich, profile


def test_best_outlet_and_error_record(spark):
    eo = spark.createDataFrame([("1", "A", "surat", 10.0, 5.0), ("2", "B", "pune", 20.0, 5.0),
                                ("3", "C", "pune", 20.0, 9.0)],
                               "outlet_id string, outlet string, city string, performance_score double, "
                               "total_revenue double")
    best = enrich.best_outlet(eo).first()
    assert (best.outlet, best.error) == ("B", None)            # tie on score -> smaller id
    only = enrich.best_outlet(eo, "SUR").first()
    assert only.outlet == "A"                                   # case-insensitive regex contains
    none = enrich.best_outlet(eo, "delhi").first()
    assert none.outlet is None and none.error == "No outlets found for filters." and none.why is None


def test_profile_report_lines(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (None, "b", 2.0), (3, None, 0.0)], "x int, y string, z double")
    p = {r.column: r for r in profile.profile_table(df, "t").collect()}
    assert (p["x"].n_missing, p["y"].n_missing, p["z"].n_zeros) == (1, 1, 2)
    assert p["y"].examples == ["a", "b"] and p["y"].n_zeros == 0
    lines = [r.line for r in profile.report_lines(profile.profile_table(df, "t")).orderBy("position").collect()]
    assert lines[0] == "| x | int | 1 | 0.33 | 0 | 0.00 | 1, 3 |"
