"""Analytics over machine-learning data, written as lazy PySpark DataFrame functions."""
