"""Accounting and invoice analytics expressed as Spark DataFrame operators."""
