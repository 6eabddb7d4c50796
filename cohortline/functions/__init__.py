"""Column expressions: text repair, dates, null policies, distribution tails."""
