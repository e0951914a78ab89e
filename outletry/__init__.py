"""PySpark analytics for outlet demand potential."""
