"""A PySpark-native engine for position-centric tables: operators, sources, functions, plans and streaming."""
