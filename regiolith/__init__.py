"""Regional cluster analytics as a library of lazy Spark DataFrame operators."""
