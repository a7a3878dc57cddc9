"""Survey microdata on Spark: coded raw files to typed, labelled DataFrames,
and the estimates made from them."""

__version__ = "0.1.0"
