"""gaugeframe: dataset-quality auditing for machine-learning data, as Spark plans."""

__version__ = "0.1.0"
