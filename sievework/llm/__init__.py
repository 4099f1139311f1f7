"""Training-data operators: ten DataFrame jobs over documents and pages, and the queries that apply them."""
