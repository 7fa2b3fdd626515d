"""Named query plans and their oracles."""
