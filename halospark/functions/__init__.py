"""Column functions: pure ``Column -> Column`` expressions, no jobs and no shuffles."""
