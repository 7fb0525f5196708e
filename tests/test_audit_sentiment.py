from pyspark.sql import functions as F

from staylens.operators import audit as H
from staylens.operators import sentiment as R


def _truth(spark, price=100.0):
    return spark.createDataFrame([(price,)], "avg_price double")


def _audit(spark, pairs, reviews_rows=1):
    answers = spark.createDataFrame(pairs, "question string, answer string")
    reviews = spark.createDataFrame([(i,) for i in range(reviews_rows)], "id long")
    return {r.answer: r for r in H.audit(answers, _truth(spark), reviews).collect()}


def test_price_thresholds(spark):
    q = "What is the average price?"
    out = _audit(spark, [(q, "About ¥109.9 a night"), (q, "About ¥110.1"), (q, "Roughly ¥120.1"),
                         (q, "It is 89.9"), (q, "no number here"), (q, "just , a comma")])
    assert not out["About ¥109.9 a night"].has_hallucination
    e = out["About ¥110.1"].errors[0]
    assert e.type == "price_mismatch" and e.severity == "medium" and abs(e.diff_pct - 10.1) < 1e-9
    assert out["Roughly ¥120.1"].errors[0].severity == "high" and out["Roughly ¥120.1"].severity == "high"
    assert out["It is 89.9"].errors[0].severity == "medium"
    assert out["no number here"].severity == "none"
    assert out["just , a comma"].severity == "none"


def test_price_rule_only_for_price_questions(spark):
    out = _audit(spark, [("How many listings?", "There are 5000")])
    assert out["There are 5000"].severity == "none"


def test_phrase_rules(spark):
    out = _audit(spark, [("q", "There are exactly 10"), ("q", "There is no data on reviews"),
                         ("q", "There is no data"), ("q", "Reviews are not available")])
    # A lone low error makes the answer "medium", as in the reference.
    assert out["There are exactly 10"].severity == "medium"
    assert out["There are exactly 10"].errors[0].type == "overconfidence"
    assert out["There is no data on reviews"].severity == "high"
    assert out["There is no data"].severity == "none"
    assert out["Reviews are not available"].errors[0].type == "false_negative"
    none = _audit(spark, [("q", "There is no data on reviews")], reviews_rows=0)
    assert none["There is no data on reviews"].severity == "none"


def test_numbers_and_hedge(spark):
    df = spark.createDataFrame([("¥1,234.5 and 7, then 3. and ,",)], "t string")
    assert df.select(H.numbers("t")).first()[0] == [1234.5, 7.0, 3.0]
    h = spark.createDataFrame([("It might be 5",), ("It is 5",)], "a string").select(H.hedge("a")).collect()
    assert h[0][0].endswith(H.HEDGE_SUFFIX) and h[1][0] == "It is 5"


def test_pass_rate(spark):
    out = H.audit(spark.createDataFrame([("q", "fine"), ("q", "exactly")], "question string, answer string"),
                  _truth(spark), spark.createDataFrame([(1,)], "id long"))
    r = H.pass_rate(out).first()
    assert (r.tested, r.passed, r.pass_rate) == (2, 1, 50.0)


def test_polarity_rules(spark):
    df = spark.createDataFrame([(1, "Great place"), (2, "not good"), (3, "terrible"), (4, None), (5, "zzz"),
                                (6, "good bad")], "id long, comments string")
    s = {r.id: r for r in R.score_reviews(df).collect()}
    assert s[1].sentiment == 0.8 and s[1].sentiment_label == "Positive"
    assert abs(s[2].sentiment - (-0.35)) < 1e-12 and s[2].sentiment_label == "Negative"
    assert s[3].sentiment == -1.0 and s[3].sentiment_label == "Negative"
    assert s[4].sentiment == 0.0 and s[5].sentiment == 0.0 and s[5].sentiment_label == "Neutral"
    assert abs(s[6].sentiment - 0.0) < 1e-12
    compat = {r.id: r for r in R.score_reviews(df, compat=True).collect()}
    assert compat[3].sentiment_label is None


def test_label_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, -0.1, 0.0, 0.1, 1.0)], "s double")
    labels = [r[0] for r in df.select(R.sentiment_label("s")).collect()]
    assert labels == ["Negative", "Negative", "Neutral", "Neutral", "Positive"]


def test_language_tag(spark):
    df = spark.createDataFrame([("the cat and the dog",), ("le chat et la souris",), ("der Hund und die Katze",),
                                ("el perro y la casa de",), ("zzz",)], "t string")
    assert [r[0] for r in df.select(R.language_tag("t")).collect()] == ["en", "fr", "de", "es", "en"]


def test_a_filter_on_the_label_scores_no_text_again(spark):
    """The predicate stays above the scoring: one tokenisation in the plan, whatever is filtered."""
    from staylens.operators import sentiment as R

    rows = [(1, "good"), (2, "bad"), (3, "not good"), (4, None), (5, "great great"), (6, "awful")]
    scored = R.score_reviews(spark.createDataFrame(rows, "id long, comments string"))
    plan = R.label_counts(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    plan = R.extremes(scored, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [(r.id, r.kind) for r in R.extremes(scored, 1).collect()] == [(5, "most_positive"), (6, "most_negative")]
