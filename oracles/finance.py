"""Oracle SQL for balances, penalties and revenue."""

from __future__ import annotations

AS_OF = "DATE '1998-06-30'"

BALANCES = """
    paid AS (SELECT InvoiceID, sum(PaymentAmount) AS amount FROM payment_transaction
             WHERE PaymentStatus = 'Completed' GROUP BY InvoiceID),
    balances AS (
      SELECT i.InvoiceID, i.StudentID, i.PaymentStatus, i.DueDate,
        CAST(i.TotalAmount + i.TaxAmount + i.LateFee - i.DiscountAmount AS DECIMAL(20,2)) AS BilledTotal,
        CAST(coalesce(p.amount, 0) AS DECIMAL(20,2)) AS PaidAmount,
        CAST(CASE WHEN i.PaymentStatus IN ('Unpaid', 'Partial', 'Overdue')
          THEN greatest(i.TotalAmount + i.TaxAmount + i.LateFee - i.DiscountAmount - coalesce(p.amount, 0), 0)
          ELSE 0 END AS DECIMAL(20,2)) AS BalanceDue
      FROM invoice i LEFT JOIN paid p USING (InvoiceID))
"""


def oracles() -> dict[str, str]:
    return {
        "invoice_balances": f"WITH {BALANCES} SELECT * FROM balances",
        "unpaid_totals": f"""WITH {BALANCES}
            SELECT StudentID, CAST(sum(BalanceDue) AS DECIMAL(20,2)) AS UnpaidTotal FROM balances GROUP BY StudentID""",
        "penalty_summary": """
            SELECT s.StudentID, CAST(coalesce(sum(p.Amount), 0) AS DECIMAL(20,2)) AS PendingPenaltyTotal,
              count(p.PenaltyID) AS PendingPenaltyCount
            FROM student s LEFT JOIN penalty p ON p.StudentID = s.StudentID AND p.Status IN ('Pending', 'Overdue')
            GROUP BY s.StudentID""",
        "invoice_statuses": f"""
            SELECT i.InvoiceID, i.PaymentStatus, CASE WHEN i.PaymentStatus = 'Cancelled' THEN 'Cancelled'
              WHEN coalesce(sum(p.PaymentAmount), 0) >= any_value(i.TotalAmount + i.TaxAmount + i.LateFee - i.DiscountAmount)
                THEN 'Paid'
              WHEN any_value(i.DueDate) < {AS_OF} THEN 'Overdue'
              WHEN coalesce(sum(p.PaymentAmount), 0) > 0 THEN 'Partial' ELSE 'Unpaid' END AS DerivedStatus
            FROM invoice i LEFT JOIN payment_transaction p ON p.InvoiceID = i.InvoiceID AND p.PaymentStatus = 'Completed'
            GROUP BY i.InvoiceID, i.PaymentStatus""",
        "view_student_financials": f"""WITH {BALANCES}
            SELECT s.StudentID, CAST(coalesce(sum(b.BilledTotal), 0) AS DECIMAL(20,2)) AS Billed,
              CAST(coalesce(sum(b.PaidAmount), 0) AS DECIMAL(20,2)) AS Paid,
              CAST(coalesce(sum(b.BalanceDue), 0) AS DECIMAL(20,2)) AS Balance
            FROM student s LEFT JOIN balances b ON b.StudentID = s.StudentID AND b.PaymentStatus <> 'Cancelled'
            GROUP BY s.StudentID""",
        "view_monthly_revenue": """
            SELECT CAST(date_trunc('month', PaymentDate) AS DATE) AS Month, count(*) AS Payments,
              CAST(sum(PaymentAmount) AS DECIMAL(20,2)) AS Revenue
            FROM payment_transaction WHERE PaymentStatus = 'Completed' GROUP BY 1""",
        "view_overdue_invoices": f"""
            SELECT InvoiceID, StudentID, DueDate,
              CAST(TotalAmount + TaxAmount + LateFee - DiscountAmount AS DECIMAL(20,2)) AS BilledTotal,
              CAST(date_diff('day', DueDate, {AS_OF}) AS BIGINT) AS DaysOverdue
            FROM invoice WHERE PaymentStatus = 'Overdue'""",
        "paid_per_invoice": """
            SELECT InvoiceID, CAST(sum(PaymentAmount) AS DECIMAL(20,2)) AS PaidAmount
            FROM payment_transaction WHERE PaymentStatus = 'Completed' GROUP BY InvoiceID""",
    }
