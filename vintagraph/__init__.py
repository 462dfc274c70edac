"""vintagraph: bitemporal series, signed graphs and text corpora on Spark DataFrames."""

__version__ = "0.1.0"
