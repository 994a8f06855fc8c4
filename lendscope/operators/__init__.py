"""Distributed operators, one module per area of the credit-risk workflow."""
