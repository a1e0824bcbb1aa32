"""Selection, matching, ranking and reporting operators."""
