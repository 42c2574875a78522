"""Ledger review and analytics for many companies at once, written as Spark plans.

Tables are keyed by ``company_id``; money is whole öre (``bigint``), so sums stay
exact, order independent and inside the code-generated aggregation path.
"""
