"""metascope: a PySpark-native engine over exports of business-application sources."""

__version__ = "0.1.0"
