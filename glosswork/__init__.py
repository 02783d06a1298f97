"""glosswork: a PySpark-native analytics engine for multilingual controlled-document libraries."""
