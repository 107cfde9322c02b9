"""PySpark-native analytics of exposure and pressure indices over panels, polygons and events."""
