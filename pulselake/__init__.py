"""pulselake: wearable-telemetry and clinical analytics on PySpark DataFrames."""
