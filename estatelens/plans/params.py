"""Parameters that queries and their SQL forms share."""

AS_OF = "2024-02-01 00:00:00"
CHUNK_TOKENS, OVERLAP_TOKENS = 100, 10
