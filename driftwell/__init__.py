"""Distribution-shift analytics as Spark DataFrame operators."""
