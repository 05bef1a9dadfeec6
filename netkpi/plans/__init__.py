"""The two reports, LTE and UMTS, put together from the operators."""
