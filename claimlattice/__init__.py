"""Claim checking on Spark: short text claims against social, news and official sources."""
