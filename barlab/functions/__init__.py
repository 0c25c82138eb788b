"""Column functions: clock, calendar, costs, account arithmetic."""
