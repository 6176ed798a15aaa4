"""Column expressions and the two shared patterns: time-bucketed joins and two-level ordered scans."""
