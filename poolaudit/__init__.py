"""poolaudit: auditing pools of text completions with PySpark DataFrames."""
