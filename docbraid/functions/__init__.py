"""Column functions: text, scripts, leaks, layout formulas, the mock engine."""
