"""wardcraft: a PySpark-native engine for precinct rules, address matching and coverage shapes."""
