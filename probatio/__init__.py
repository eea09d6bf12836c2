"""probatio: document integrity and fraud-risk scoring on PySpark DataFrames."""
