"""Invoices, balances, penalties and revenue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.functions.columns import billed_total, date_value, money, zero_money
from hallkeeper.operators import facts
from hallkeeper.tables import Tables

OUTSTANDING = ("Unpaid", "Partial", "Overdue")
OPEN_PENALTY = ("Pending", "Overdue")


def invoice_balances(t: Tables) -> DataFrame:
    """Billed, paid and outstanding amount of every invoice."""
    invoices = t.invoice.join(facts.paid_per_invoice(t), "InvoiceID", "left")
    billed = money(billed_total())
    paid = money(F.coalesce("PaidAmount", F.lit(0)))
    outstanding = F.col("PaymentStatus").isin(*OUTSTANDING)
    return invoices.select(
        "InvoiceID",
        "StudentID",
        "PaymentStatus",
        "DueDate",
        billed.alias("BilledTotal"),
        paid.alias("PaidAmount"),
        money(F.when(outstanding, F.greatest(billed - paid, zero_money())).otherwise(zero_money())).alias("BalanceDue"),
    )


def unpaid_totals(t: Tables) -> DataFrame:
    """(StudentID, UnpaidTotal): outstanding balance per invoiced student."""
    return invoice_balances(t).groupBy("StudentID").agg(money(F.sum("BalanceDue")).alias("UnpaidTotal"))


def penalty_summary(t: Tables) -> DataFrame:
    """(StudentID, PendingPenaltyTotal, PendingPenaltyCount) for every student."""
    pending = (
        t.penalty.filter(F.col("Status").isin(*OPEN_PENALTY))
        .groupBy("StudentID")
        .agg(money(F.sum("Amount")).alias("total"), F.count(F.lit(1)).alias("n"))
    )
    return t.student.select("StudentID").join(pending, "StudentID", "left").select(
        "StudentID",
        F.coalesce("total", zero_money()).alias("PendingPenaltyTotal"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("PendingPenaltyCount"),
    )


def invoice_statuses(t: Tables, as_of: dt.date) -> DataFrame:
    """(InvoiceID, PaymentStatus, DerivedStatus) for every invoice."""
    settled = t.invoice.join(facts.paid_per_invoice(t), "InvoiceID", "left").withColumn("BilledTotal", billed_total())
    return settled.select(
        "InvoiceID", "PaymentStatus", facts.derived_invoice_status(date_value(as_of)).alias("DerivedStatus")
    )


def student_financials(t: Tables) -> DataFrame:
    """Billed, paid and balance per student over invoices that are not cancelled."""
    per_student = (
        invoice_balances(t)
        .filter(F.col("PaymentStatus") != "Cancelled")
        .groupBy("StudentID")
        .agg(*[money(F.sum(c)).alias(n) for n, c in (("b", "BilledTotal"), ("p", "PaidAmount"), ("d", "BalanceDue"))])
    )
    return t.student.select("StudentID").join(per_student, "StudentID", "left").select(
        "StudentID",
        *[F.coalesce(c, zero_money()).alias(n) for n, c in (("Billed", "b"), ("Paid", "p"), ("Balance", "d"))],
    )


def monthly_revenue(t: Tables) -> DataFrame:
    """Completed payments by month."""
    completed = t.payment_transaction.filter(F.col("PaymentStatus") == "Completed")
    return completed.groupBy(F.trunc("PaymentDate", "month").alias("Month")).agg(
        F.count(F.lit(1)).alias("Payments"), money(F.sum("PaymentAmount")).alias("Revenue")
    )


def overdue_invoices(t: Tables, as_of: dt.date) -> DataFrame:
    """Invoices marked overdue, with the days since they were due."""
    return t.invoice.filter(F.col("PaymentStatus") == "Overdue").select(
        "InvoiceID",
        "StudentID",
        "DueDate",
        money(billed_total()).alias("BilledTotal"),
        F.datediff(date_value(as_of), "DueDate").cast("bigint").alias("DaysOverdue"),
    )
