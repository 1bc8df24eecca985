"""SQL expressions: missing-aware recodes, label lookups, text labels, t quantiles.

Expressions are kept as SQL text, which Spark parses in one step however long it
is; ``F.expr`` turns any of them into a column.
"""
