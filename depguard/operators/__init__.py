"""Detection, repair and cleaning operators."""
