"""Weather-signal and anomaly analytics as PySpark DataFrame operators."""
