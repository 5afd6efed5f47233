"""Query plans over the test tables (registered in ``__spark_entry__``) and their SQL oracles."""
