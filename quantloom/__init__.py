"""Market analytics on Spark: time-series, cross-section and back-test operators as DataFrame functions."""
