"""A corpus search engine on Spark: retained bytes, verified text units, ranked and exact search over pinned generations."""
