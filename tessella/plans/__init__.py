"""The registered queries, their SQL, and domain views over the test tables."""
