"""Stances on their borders."""

from tidemark.operators import portfolio


def test_news_sentiment_on_a_border_lies_on_it(spark):
    rows = [(1, "a" * 116 + "b" * 8, "positive"), (2, "a" * 16 + "b" * 58, "negative"), (3, "a" * 115 + "b" * 8, "neutral"), (4, None, "neutral")]
    docs = spark.createDataFrame(rows, "id int, text string, want string")
    got = portfolio.news_scores(docs, {"positive": ["a"], "negative": ["b"]}, {"positive": 0.01, "negative": -0.02}).collect()
    assert [r.stance for r in got] == [r.want for r in got]
