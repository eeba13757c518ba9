"""pulsegrid: labelled metric samples, vector algebra and alerting on PySpark DataFrames."""
