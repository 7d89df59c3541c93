"""From checked rules to plans: evaluation on one machine, over DataFrames, and rewritings of rules."""
