"""corpuslab: auditing, cleaning, splitting and evaluating labelled text corpora with PySpark."""
