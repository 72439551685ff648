"""buoyline: device telemetry on Spark.

Messages (topic + JSON payload) are decoded, validated and normalised into
typed records, stored as time-series points where the last write wins, and
read back as device history, latest state and active-device sets. Every
operator is a DataFrame function that runs in batch and, where it makes
sense, in Structured Streaming.
"""

__version__ = "0.1.0"
