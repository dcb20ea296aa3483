"""Event values on small cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import event_values as op


@pytest.mark.parametrize("title", ["", "plain", "dividend increase and buy-back", "class action: investigation", "rights issue 增发", "director's interest in a contract", "x" * 5000 + "war"])
def test_one_pass_finds_what_each_list_would(title):
    assert op.lists_in(title) == sum(1 << i for i, terms in enumerate(op.TERMS.values()) if any(t in title for t in terms))


def test_values_and_edges(spark):
    rows = [
        (1, "news", "Guidance raised, dividend", "ASX", None, None, None), (2, "news", None, None, "Bearish", None, None), (3, None, "", "", "nan", "200", None),
        (4, "macro", "Rate Hike", "asx", "0.2", "-250", 55.0), (5, "financial_disclosures", "Appendix 3", "exchange-announcement", None, None, None), (6, "social", "placement delay", "x", "-30", "abc", None),
    ]
    df = spark.createDataFrame(rows, "id int, kind string, title string, source string, mood string, rel string, rates double").withColumns({"bits_": F.lit("x"), "event_sentiment": F.lit("clash")})
    out = {r.id: r for r in op.event_values(df, "kind", "title", "source", {"sentiment": "mood", "relevance": "rel", "macro_rates_impulse": "rates"}).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6}
    a = out[1]
    assert (a.event_sentiment, a.event_relevance, a.event_novelty, a.source_quality, a.capital_allocation, a.earnings_event, a.event_intensity) == (1.0, 1.0, 0.8, 1.0, 1.0, 1.0, 0.6)
    assert (out[2].event_sentiment, out[2].event_intensity, out[2].source_quality, out[2].announcement_score) == (-1.0, 0.0, 0.55, 0.0)
    assert (out[3].event_sentiment, out[3].event_relevance, out[3].source_quality) == (0.0, 1.0, 0.45)
    assert (out[4].macro_risk, out[4].event_relevance, out[4].macro_rates_impulse, out[4].macro_fx_impulse, out[4].event_intensity, out[4].event_sentiment) == (-1.0, -1.0, 0.55, 0.0, 0.35, 0.2)
    assert (out[5].event_relevance, out[5].event_novelty, out[5].announcement_score, out[5].event_intensity) == (0.3, 0.15, 0.15, 0.2)
    assert (out[6].event_sentiment, out[6].event_relevance, out[6].capital_allocation, out[6].dilution_risk, out[6].negative_catalyst) == (-0.3, 0.75, -1.0, 1.0, 1.0)
    assert out[1].macro_rates_impulse is None
    assert op.event_values(df.filter("false"), "kind", "title", "source").count() == 0
