"""pagelore: page-access analytics over sorted key relations, on PySpark."""
