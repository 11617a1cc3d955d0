"""plumbline: construction quantity takeoff and corpus preparation as Spark DataFrame operators."""
