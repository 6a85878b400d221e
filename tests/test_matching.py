from labelspark import fixed_values as V
from labelspark.operators import matching as M

W = V.OFFICIAL_WARNING


def _rows(spark, rows, columns):
    typed = ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{typed}, n int")


def test_brand_goldens(spark):
    from pyspark.sql import functions as F

    noisy = "i, = -\na\nrn Tt\n__ o\ny 1l\nqq\nzz"
    cases = [
        ("Stone's Throw", "STONE'S THROW", True), ("Stone's Throw", "stones throw", True),
        ("Stone's Throw", "STONE'S THROW BREWING CO", True),
        ("Stone's Throw", "Riverbend Brewing", False), ("Stone's Throw", "", False),
        ("Bud", "STONE'S THROW BREWING CO\nPALE ALE\n12 FL OZ", False), ("Bud", "BUD", True),
        ("Jack Daniel's", noisy, False),
        ("Jack Daniel's", "JACK DANIEL'S OLD NO. 7 TENNESSEE WHISKEY", True),
    ]
    df = M.with_best_lines(_rows(spark, [c[:2] for c in cases], ["brand", "text"]),
                           {"b": "brand"}, "text")
    got = df.select("n", M.match_brand(F.col("brand"), F.col("b"))["passed"].alias("p")).collect()
    assert {r.n: r.p for r in got} == {i: c[2] for i, c in enumerate(cases)}


def test_alcohol_goldens(spark):
    cases = [
        ("5.0", "ALC 5% BY VOL", True), ("5.0", "5.0% ABV", True), ("5.0", "5% ALC/VOL", True),
        ("5.0", "10 PROOF", True), ("5.0", "ALC 7.5% BY VOL", False),
        ("5.0", "no statement", False), ("40", "80 PROOF", True),
        ("5.0", "ALC 8% BY VOL.\nContains 5% real fruit juice", False),
        ("40", "ALC 10% SERVING ... 80 proof", True), ("abc", "5% ABV", False),
        ("5.05", "5.0% ABV", True), ("80 proof", "80 proof", False),
    ]
    df = _rows(spark, [c[:2] for c in cases], ["claim", "text"])
    got = {r.n: r.r for r in M.with_alcohol_match(df, "claim", "text", "r").collect()}
    assert {n: r.passed for n, r in got.items()} == {i: c[2] for i, c in enumerate(cases)}
    assert "8%" in got[7].found
    assert got[9].found == V.MSG_ABV_CLAIM_BAD


def test_warning_goldens(spark):
    noise = W.replace("pregnancy", "prxgnxncx").replace("machinery", "mxchxnxry")
    cases = [
        (W, 90.0, "PASS", ""), (W.replace(" ", "\n", 5), 90.0, "PASS", ""),
        (W.replace("machinery", "machmery"), 90.0, "PASS", ""),
        (W.replace("GOVERNMENT WARNING", "Government Warning"), 90.0, "FLAG", ""),
        ("GOVERNMENT WARNING: enjoy this safe and pleasant drink", 90.0, "FLAG", ""),
        (W.replace("drink", "drink and harm", 1), 90.0, "REVIEW", "unreadable"),
        (noise, 90.0, "REVIEW", "unreadable"),
        (W.replace(" not ", " "), 90.0, "REVIEW", "unreadable"),
        ("plain label text", 92.0, "REVIEW", "absent"), ("plain label", 55.0, "REVIEW", "absent"),
        ("plain label", 20.0, "REVIEW", "unreadable"), ("plain", 54.0, "REVIEW", "unreadable"),
        (W.upper(), 90.0, "FLAG", ""), (W + " abcd", 90.0, "PASS", ""),
        (W + " abcde", 90.0, "REVIEW", "unreadable"),
    ]
    df = spark.createDataFrame([(t, c, i) for i, (t, c, _, _) in enumerate(cases)],
                               "text string, confidence double, n int")
    for r in M.with_warning_match(df, "text", "confidence", "r").collect():
        want = cases[r.n]
        got = "PASS" if r.r.passed else "REVIEW" if r.r.inconclusive else "FLAG"
        assert (got, r.r.review_kind) == want[2:], (r.n, r.r)


def test_net_goldens(spark):
    label = "Stone's Throw\nCabernet Sauvignon\n750 mL"
    cases = [
        ("750 mL", label, "PASS"), ("0.75 L", label, "PASS"), ("375 mL", label, "FLAG"),
        ("750 mL", "Stone's Throw", "REVIEW"), ("a bottle", label, "FLAG"),
        ("1 L", "BIG\n1,000 mL", "PASS"), ("1,000 mL", "BIG\n1,000 mL", "PASS"),
        ("0.75 L", "X\n0,75 L", "PASS"),
    ]
    df = _rows(spark, [c[:2] for c in cases], ["claim", "text"])
    for r in M.with_net_match(df, "claim", "text", "r").collect():
        got = "PASS" if r.r.passed else "REVIEW" if r.r.inconclusive else "FLAG"
        assert got == cases[r.n][2], (cases[r.n], r.r)


def test_class_type_goldens(spark):
    from pyspark.sql import functions as F

    label = "BARREL OAK\nCabernet Sauvignon\nNapa Valley\n750 mL"
    cases = [
        ("Cabernet Sauvignon", "PASS"), ("Cabernet Sauvignon Reserve", "FLAG"),
        ("Chardonnay", "REVIEW"), ("Gin", "REVIEW"), ("Rum", "REVIEW"), ("Port", "REVIEW"),
    ]
    df = M.with_best_lines(_rows(spark, [(c[0], label) for c in cases], ["c", "text"]),
                           {"b": "c"}, "text")
    for r in df.select("n", M.match_class_type(F.col("c"), F.col("b")).alias("r")).collect():
        got = "PASS" if r.r.passed else "REVIEW" if r.r.inconclusive else "FLAG"
        assert got == cases[r.n][1], (cases[r.n], r.r)


def test_format_general_matches_python(spark):
    from pyspark.sql import functions as F

    from labelspark.functions.text import format_general

    values = [0.0, 5.0, 7.5, 133.33333, 1234567.0, 999999.5, 0.00001, 0.00012345678, 12.50,
              100000.0, 0.1, 1e22, -3.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", format_general(F.col("v")).alias("s")).collect():
        assert r.s == f"{r.v:g}"
