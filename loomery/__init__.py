"""loomery: DataFrame-first preparation and evaluation of conversation corpora on Spark."""
