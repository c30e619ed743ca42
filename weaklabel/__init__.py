"""weaklabel: text classification with missing labels on Spark DataFrames."""

__version__ = "0.1.0"
