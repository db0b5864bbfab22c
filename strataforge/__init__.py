"""Spark-native code, session, snapshot and text analytics."""
