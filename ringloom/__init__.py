"""ringloom: a PySpark-native engine for finding and explaining coordinated account groups."""
