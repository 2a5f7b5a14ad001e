"""Behaviour-risk analytics on Spark: canonical events, decayed risk scores, attribution, bands and streams."""
