"""Cross-sectional signal analytics on Spark."""
