"""Reading survey tables, writing results, and tables derived from generic ones."""
