"""cadence: Spark-native feature, validation and scoring operators for keyed transcript tables."""

__version__ = "0.1.0"
