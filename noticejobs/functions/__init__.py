"""Column functions: text, dates, sizes, routing of questions. All are built-in Spark expressions."""
