"""Timed-text analytics on Spark: DataFrame-to-DataFrame operators over ordered, timed segments."""
