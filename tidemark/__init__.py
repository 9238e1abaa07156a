"""Equity signal research on Spark: bars, flows, holdings, news in; features, scores, rankings, metrics out."""
