"""Fixed values of the two rule sets: categories and their patterns in the order in which they are tried."""

from __future__ import annotations

# Fixed values.

#: Categories outside profit and loss.
NON_PNL: dict[str, tuple[str, ...]] = {
    "Account Transfer": (
        r"WEB\s+XFER",
        r"ZELLE",
        r"PAYPAL\s+INST\s+XFER",
    ),
    "Credit Card Payment": (
        r"\bCAPITAL\s+ONE\b",
        r"\bCHIME\b",
        r"\bCREDIT\s+CARD\s+PAYMENT\b",
    ),
    "Loan Proceeds": (
        r"\bLOAN\s+PROCEEDS?\b",
        r"\bLOAN\s+DISBURSEMENT\b",
    ),
    "Payment Reversal": (
        r"RETURNED\s+ITEM.*INSUFFICIENT\s+FUNDS",
    ),
    "Loan Principal Payment": (
        r"APEX\s+CAPITAL\s+FUNDING",
    ),
    "Loan Interest": (),
    "Owner Contribution": (
        r"\bOWNER\s+CONTRIBUTION\b",
    ),
    "Owner Draw or Distribution": (
        r"\bOWNER\s+DRAW\b",
        r"\bDISTRIBUTION\b",
    ),
    "Fixed Asset Purchase": (
        r"\bTRUCK\s+PURCHASE\b",
        r"\bEQUIPMENT\s+PURCHASE\b",
    ),
    "Tax Payment": (
        r"\bTAX\s+PAYMENT\b",
        r"IOWA\s+JUDICIAL\b",
    ),
    "Refund": (
        r"\bREFUND\b",
    ),
    "Reimbursement": (
        r"\bREIMBURSEMENT\b",
    ),
    "Opening Balance": (),
    "Uncategorized": (),
    "CPA Review Required": (),
}

#: Expense categories.
EXPENSE: dict[str, tuple[str, ...]] = {
    "Fuel": (
        r"\bPILOT\b",
        r"FLYING\s*J",
        r"LOVE'?S",
        r"KWIK\s*STAR",
        r"\bCASEYS?\b",
        r"\bMARATHON\b",
        r"\bYESWAY\b",
        r"CIRCLE\s*K",
        r"\bTRAVEL\s+CNT\b",
        r"\bTRAVEL\s+CENTER\b",
        r"\bTA\b\s+(?:#\d+\s+)?[A-Z]{3,}",
        r"\bBP#\d",
        r"\bBB\s+OF\s+HOUSTON\b",
        r"\bBREAK\s+TIME\b",
        r"\bSHELL\b.*SERVICE",
        r"\b59\s+FASTLANE\b",
        r"\bCTLP\b",
        r"\bWOODSHED\b",
        r"\bPORT\s+AUTO\s+TRUCK\b",
        r"\bTEX\s+BEST\b",
        r"\bTBS\b.*DENISON",
        r"\bDIESEL\b",
        r"\bGAS\b.*\bSTATION\b",
    ),
    "Freight and Shipping": (
        r"\bFREIGHT\s+(?:CHARGE|FEE|COST)\b",
        r"\bSHIPPING\b",
    ),
    "Subcontractors": (
        r"\bSUBCONTRACTOR\b",
        r"\bSUBCONTRACT\b",
    ),
    "Direct Labor": (
        r"\bDIRECT\s+LABOR\b",
    ),
    "Materials and Supplies": (
        r"\bMATERIALS\b",
        r"\bSUPPLIES\b",
    ),
    "Equipment Rental": (
        r"\bEQUIPMENT\s+RENTAL\b",
        r"\bTRAILER\s+RENTAL\b",
        r"\bRENTAL\s+EQUIPMENT\b",
    ),
    "Tolls and Scale Fees": (
        r"\bTOLL\b",
        r"\bSCALE\s+FEE\b",
        r"\bWEIGH\s+STATION\b",
    ),
    "Other Direct Costs": (),
    "Advertising and Marketing": (
        r"\bADVERTISING\b",
        r"\bMARKETING\b",
        r"\bDAT\s+SOLUTIONS\b",
        r"\bLOAD\s*BOARD\b",
        r"\b123LOADBOARD\b",
    ),
    "Bank and Merchant Fees": (
        r"MasterCard Cross Border",
        r"SALES\s+TAX\b",
        r"Overdraft",
        r"FEE\s+FOR\s+DDA",
        r"DDA\s+WITHDRAWAL",
        r"Incoming Wire Transfer Fee",
        r"\bWIRE\s+TRANSFER\s+FEE\b",
        r"^SERVICE\s+CHARGE$",
    ),
    "Business Insurance": (
        r"\bPROGRESSIVE\s+INS\b",
        r"\bINSURANCE\b",
    ),
    "Commissions": (
        r"\bCOMMISSION\b",
    ),
    "Contract Labor": (
        r"\bCONTRACT\s+LABOR\b",
    ),
    "Depreciation Placeholder": (),
    "Dues and Subscriptions": (
        r"\bDUES\b",
        r"\bMEMBERSHIP\b",
    ),
    "Employee Benefits": (
        r"\bBENEFITS\b",
    ),
    "Equipment Maintenance": (
        r"\bPARTS\b",
        r"\bREPAIR\s+SHOP",
        r"\bTRUCK\s+REPAIR",
        r"\bMAINTENANCE\s+SHOP",
        r"\bTIRE\s+SERVICE",
        r"O'REILLY\s+AUTO",
        r"\bAUTO\s+ZONE\b",
    ),
    "Legal and Professional Fees": (
        r"\bLEGAL\b",
        r"\bATTORNEY\b",
        r"\bLAW\s+OFFICE\b",
        r"\bLEGALSHIELD\b",
    ),
    "Licenses and Permits": (
        r"\bLICENSE\b",
        r"\bPERMIT\b",
        r"\bREGISTRATION\b",
    ),
    "Meals": (
        r"SONIC\s+DRIVE",
        r"\bARBYS?\b",
        r"MCDONALD",
        r"\bARANDAS\b",
        r"DOORDASH",
        r"\bWENDYS?\b",
        r"BURGER\s+KING",
        r"TACO\s+JOHN",
        r"PANCHEROS[\s-]*MEXICA",
        r"CARL'?S\s*JR",
        r"\bDENNY'?S?\b",
        r"\bHARDEE'?S\b",
        r"DAIRY\s+QUEEN",
        r"\bHAYMAKERS?\b",
        r"STILL\s+SMOKIN",
        r"HONG\s+KONG\s+BUFFET",
        r"\bRESTAURANT\b",
    ),
    "Office Expense": (
        r"\bOFFICE\b",
        r"\bSTAPLES\b",
        r"\bOFFICE\s+DEPOT\b",
    ),
    "Payroll": (
        r"\bPAYROLL\b",
        r"\bSALARY\b",
        r"\bWAGES\b",
    ),
    "Payroll Taxes": (
        r"\bPAYROLL\s+TAX\b",
    ),
    "Rent or Lease": (
        r"\bOFFICE\s+RENT\b",
        r"\bPROPERTY\s+LEASE\b",
        r"\bRENT\s+PAYMENT\b",
    ),
    "Repairs and Maintenance": (
        r"\bREPAIR\b",
        r"\bMAINTENANCE\b",
        r"\bGENERAL\s+REPAIR\b",
    ),
    "Software and Cloud Services": (
        r"GOOGLE\s+LLC\s+GSUIT",
        r"\bGSUITE\b",
        r"\bMICROSOFT\s*365\b",
        r"\bDROPBOX\b",
        r"\bSOFTWARE\b",
        r"\bCLOUD\b",
    ),
    "Taxes and Fees": (
        r"\bTAX\b",
        r"\bFEE\b",
    ),
    "Telephone and Internet": (
        r"\bSTRAIGHT\s*TALK\b",
        r"\bVERIZON\b",
        r"\bAT&T\b",
        r"\bT-MOBILE\b",
        r"\bINTERNET\b",
        r"\bPHONE\b",
    ),
    "Travel": (
        r"\bTRAVEL\b",
        r"\bHOTEL\b",
        r"\bMOTEL\b",
        r"\bAIRLINE\b",
        r"\bFLIGHT\b",
    ),
    "Utilities": (
        r"\bALLIANT\s+ENERGY\b",
        r"\bUTILITY\b",
        r"\bELECTRIC\b",
        r"\bWATER\b",
        r"\bGAS\s+COMPANY\b",
    ),
    "Vehicle Expense": (
        r"TRUCK\s*PARKING",
        r"\bCAR\s*WASH\b",
        r"\bTIRE\b",
        r"\bOIL\s+CHANGE\b",
    ),
}

#: Income categories.
INCOME: dict[str, tuple[str, ...]] = {
    "Sales Revenue": (
        r"\bINVOICE\b",
        r"\bSALE\b.*\bREVENUE\b",
    ),
    "Service Revenue": (
        r"\bSERVICE\s+REVENUE\b",
    ),
    "Freight Revenue": (
        r"\bFREIGHT\b",
        r"\bTRUCKING\s+REVENUE\b",
        r"Incoming\s+Wire\s+.*APEX\s+CAPITAL\s+CORP",
    ),
    "Contract Revenue": (
        r"\bCONTRACT\s+PAY(?:MENT)?\b",
    ),
    "Other Operating Income": (
        r"\bOPERATING\s+INCOME\b",
    ),
    "Interest Income": (
        r"\bINTEREST\s+(?:PAID|EARNED|INCOME)\b",
    ),
    "Refunds and Reimbursements": (
        r"\bREFUND\b",
        r"\bREIMBURSEMENT\b",
        r"\bREBATE\b",
    ),
    "Other Income": (
        r"\bOTHER\s+INCOME\b",
    ),
}

#: Tax category of a business category; any other is "Other Expense".
TAX_CATEGORY: dict[str, str] = {
    "Fuel": "Vehicle Fuel",
    "Freight and Shipping": "Freight & Shipping",
    "Subcontractors": "Contract Labor",
    "Direct Labor": "Direct Labor",
    "Materials and Supplies": "Materials & Supplies",
    "Equipment Rental": "Equipment Rental",
    "Tolls and Scale Fees": "Tolls & Fees",
    "Other Direct Costs": "Other Direct Costs",
    "Advertising and Marketing": "Advertising",
    "Bank and Merchant Fees": "Bank Charges",
    "Business Insurance": "Insurance",
    "Commissions": "Commissions",
    "Contract Labor": "Contract Labor",
    "Depreciation Placeholder": "Depreciation",
    "Dues and Subscriptions": "Dues & Subscriptions",
    "Employee Benefits": "Employee Benefits",
    "Equipment Maintenance": "Repairs & Maintenance",
    "Legal and Professional Fees": "Legal & Professional",
    "Licenses and Permits": "Licenses & Permits",
    "Meals": "Meals (50%)",
    "Office Expense": "Office Expenses",
    "Payroll": "Wages & Salaries",
    "Payroll Taxes": "Payroll Taxes",
    "Rent or Lease": "Rent Expense",
    "Repairs and Maintenance": "Repairs & Maintenance",
    "Software and Cloud Services": "Software & Cloud",
    "Taxes and Fees": "Taxes & Licenses",
    "Telephone and Internet": "Telephone & Internet",
    "Travel": "Travel",
    "Utilities": "Utilities",
    "Vehicle Expense": "Vehicle Expenses",
}
