"""The registered queries in ANSI SQL, written independently of the Spark code."""
