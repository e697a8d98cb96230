"""Lodestone: a PySpark-native analytics engine for object catalogs and text collections."""
