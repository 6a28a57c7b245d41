"""Post-training data work as Spark DataFrame and Column functions."""
