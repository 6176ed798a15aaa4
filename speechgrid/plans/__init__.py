"""The registered queries, grouped by subject, each with the SQL it must agree with."""
