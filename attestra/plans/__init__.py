"""Tables derived from the driver's, the book of queries with SQL, staging of intermediate tables, shipping of code."""
