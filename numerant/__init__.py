"""Figure provenance on Spark: where the numbers in answers come from, for many documents and answers at once."""
