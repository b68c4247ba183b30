"""Analytics over hierarchical 3D-geospatial tile datasets and their telemetry, on Spark."""
