"""Fixed values of the finance domain: category slugs, buckets, markers and thresholds."""

from __future__ import annotations

# Category slugs that are spending, and those that are income.
EXPENSE_SLUGS = [
    "bill_payment", "car_maintenance", "cash_withdrawal", "charity_gift", "dining", "education", "emi_loan", "entertainment", "expense", "fees_charges", "fuel",
    "gift", "groceries", "healthcare", "insurance", "personal_care", "rent", "shopping", "subscriptions", "tax", "transport", "travel", "utilities",
]
INCOME_SLUGS = ["cashback_rewards", "interest", "investment_redemption", "other_income", "refund", "repayment", "salary", "tax_refund"]

# Report buckets by slug.
BUCKETS = {
    "income": ["interest", "other_income", "salary", "tax_refund"],
    "expense": [*EXPENSE_SLUGS, "cashback_rewards", "misc", "refund", "reimbursement"],
    "investment": ["investment", "investment_redemption"],
    "internal": ["credit_card_payment", "self_transfer"],
    "transfers_in": ["repayment"],
    "family": ["family"],
}
# Labels that are not the slug's words in title case.
LABELS = {
    "credit_card_payment": "Card bills", "emi_loan": "EMI / Loan", "cash_withdrawal": "Cash Withdrawal", "cashback_rewards": "Cashback Rewards",
    "fees_charges": "Fees & Charges", "charity_gift": "Charity & Gifts",
}
# Inbound slugs that a credit card can't receive.
CARD_IMPOSSIBLE = ["interest", "other_income", "repayment", "salary"]
# Days after which a balance of a category counts as stale.
STALE_DAYS = {"bank_balance": 45, "cc_outstanding": 35, "investment": 90, "manual_asset": 180, "manual_liability": 180}
# Whole-token narration markers.
CARD_PAYMENT_MARKERS = ["bbps pmt", "bill payment", "bill repayment", "bppy", "card payment", "cc payment", "credit card payment", "payment received"]
CARD_REFUND_MARKERS = ["cancellation", "chargeback", "refund", "refunded", "reversal", "reversed"]
FEE_REVERSAL_MARKERS = [
    "annual charges reversal", "annual charges reversed", "annual fee refund", "annual fee reversal", "annual fee reversed", "card fee reversal", "card fee reversed",
    "fee refund", "fee reversal", "fee reversed", "fee waived", "fees refund", "fees reversed", "fees waived", "finance charges reversal", "finance charges reversed",
    "joining fee reversal", "joining fee reversed", "late fee reversal", "late fee reversed",
]
# Words inside a transaction type that tell acquisitions and disposals of units.
ACQUISITIONS = ["allotment", "buy", "purchase", "switch-in", "switch_in"]
DISPOSALS = ["redemption", "sell", "sold", "switch-out", "switch_out"]


def bucket_sql(slug: str, bank_scope: bool) -> str:
    """SQL for the report bucket of a slug, the same text for Spark and DuckDB; over the bank, a card bill is an expense."""
    listed = {b: [*s, "credit_card_payment"] if bank_scope and b == "expense" else [x for x in s if not (bank_scope and x == "credit_card_payment")] for b, s in BUCKETS.items()}
    cases = " ".join(f"WHEN {slug} IN ({', '.join(repr(x) for x in s)}) THEN '{b}'" for b, s in listed.items())
    return f"CASE {cases} ELSE 'uncategorized' END"


def known_slugs() -> list[str]:
    return sorted({s for slugs in BUCKETS.values() for s in slugs})
