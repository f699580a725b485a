"""Documents that an account has to hand in, and how their status is shown."""

from __future__ import annotations

# Fixed values.
DOCUMENTS: dict[str, str] = {
    "bank_statements": "Bank Statements",
    "credit_card_statements": "Business Credit-Card Statements",
    "loan_statements": "Loan Statements",
    "payroll_reports": "Payroll Reports",
    "quarterly_payroll_filings": "Quarterly Payroll Filings",
    "forms_w2": "Forms W-2",
    "forms_1099": "Forms 1099",
    "contractor_w9": "Contractor W-9 Forms",
    "sales_tax_filings": "Sales-Tax Filings",
    "prior_year_tax_return": "Prior-Year Tax Return",
    "fixed_asset_docs": "Fixed-Asset Purchase Documents",
    "vehicle_docs": "Vehicle Purchase/Lease Documents",
    "mileage_logs": "Mileage Logs",
    "insurance_statements": "Insurance Statements",
    "merchant_processor_reports": "Merchant-Processor Reports",
    "ar_records": "Accounts-Receivable Records",
    "ap_records": "Accounts-Payable Records",
    "inventory_records": "Inventory Records",
    "owner_contribution_records": "Owner Contribution Records",
    "owner_distribution_records": "Owner Distribution Records",
    "estimated_tax_confirmations": "Estimated-Tax Payment Confirmations",
    "business_license": "Business License Records",
    "home_office_records": "Home-Office Records",
    "health_insurance_docs": "Health Insurance Documentation",
}
STATUS: dict[str, str] = {
    "provided": "[x] Provided",
    "not-provided": "[ ] Not Provided",
    "partial": "[~] Partial",
}
