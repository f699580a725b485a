"""Fixed values of the personal rule set: categories and their patterns in the order in which they are tried."""

from __future__ import annotations

# Fixed values.

#: Spending categories.
PERSONAL: dict[str, tuple[str, ...]] = {
    "Payroll": (),
    "Deposit": (
        r"\bDEPOSIT\b",
    ),
    "Rent": (),
    "Insurance": (
        r"PROGRESSIVE INS",
    ),
    "Transfers": (
        r"WEB XFER",
        r"ZELLE",
        r"PAYPAL INST XFER",
    ),
    "Fuel": (
        r"\bPILOT\b",
        r"FLYING J",
        r"LOVE'?S",
        r"KWIK STAR",
        r"\bMARATHON\b",
        r"\bYESWAY\b",
        r"CIRCLE K",
        r"\bTRAVEL CNT\b",
        r"\bTRAVEL CENTER",
        r"\bTA\b\s+(?:#\d+\s+)?[A-Z]{3,}",
        r"\bCASEYS\b",
        r"\bBP#\d",
        r"\bBB OF HOUSTON\b",
        r"\bBREAK TIME\b",
        r"\bSHELL\b.*SERVICE",
        r"\b59 FASTLANE\b",
        r"\bCTLP\b",
        r"\bWOODSHED\b",
        r"\bPORT AUTO TRUCK\b",
        r"\bTEX BEST\b",
        r"\bTBS\b.*DENISON",
    ),
    "Restaurants": (
        r"SONIC DRIVE",
        r"\bARBYS?\b",
        r"MCDONALD",
        r"TEXAS BEST (?:SMOKE|BBQ)",
        r"HOSHI JAPANE",
        r"\bARANDAS\b",
        r"DOORDASH",
        r"HUCK'?S FOOD",
        r"\bWENDYS?\b",
        r"BURGER KING",
        r"TACO JOHN",
        r"PANCHEROS[\s-]*MEXICA",
        r"CARL'?S\s*JR",
        r"\bDENNY'?S?\b",
        r"\bHARDEE'?S\b",
        r"DAIRY QUEEN",
        r"\bHAYMAKERS?\b",
        r"STILL SMOKIN",
        r"HONG KONG BUFFET",
    ),
    "Groceries": (
        r"WAL-MART",
        r"WALMART",
        r"WM SUPERCENTER",
        r"HY[ -]?VEE",
    ),
    "Subscriptions": (
        r"PAYPAL.*DISCORD",
        r"PAYPAL PURCHASE.*(?:HIDIVE|TWITCH|YOUTUBE|DASHDRAM|STORYMAT|SHRIKELI|CLOCKWOR|NETSHORT)",
        r"APPLE\W?COM.*BILL",
        r"GOOGLE\s+(?!.*(?:DramaBox|My Drama|DashDram|StoryMat))",
        r"NETFLIX",
        r"HULU",
        r"OPENAI",
        r"LEGALSHIELD",
        r"Oracle America",
        r"AMAZON PRIME",
        r"Prime Video",
        r"WL STEAM",
        r"CLOUD FACTORY",
        r"EXPERIAN\b",
        r"SHORTMAX",
        r"\biDrama\b",
        r"DramaBox",
        r"My Drama",
        r"DashDram",
        r"StoryMat",
        r"ANOMALY",
        r"\bAudible\b",
        r"TV.?C PRO DRIVER",
        r"HIDIVE",
        r"HFinance.*Simplex",
        r"Dramawave",
        r"\bNETSHORT\b",
        r"\bSTORYREEL\b",
    ),
    "Shopping": (
        r"AMAZON\b.*\b(?:MARK|MKTPL)\b",
        r"\bSQ\b(?!.*HOSHI)",
        r"SHIP'?S PLACE",
        r"THE KERR SPOT",
        r"LOWE'?S\b",
        r"\bTRACTOR SUPPLY\b",
        r"\bDOLLAR.GENERAL\b",
        r"WESTLAND THEATRE",
        r"MNRD-WESTBULITN",
    ),
    "Auto Care": (
        r"LAZER SPOT",
        r"HOMETOWN CARWASH",
        r"PETRO DODGE",
        r"TRUCKPARKINGCLUB",
    ),
    "Utilities": (
        r"ALLIANT ENERGY",
        r"ALLPAID",
        r"FARMERS ELEVATOR",
        r"SCHOOL PROCESSIN",
    ),
    "Loan/Credit Payment": (
        r"CAPITAL ONE",
        r"JD BYRIDER",
        r"\bChime\b",
    ),
    "Bank Fees": (),
    "Checks": (
        r"CHECK #",
    ),
    "Government": (
        r"IOWA JUDICIAL",
        r"\bUSPS\b",
    ),
}

#: Tried before the table, in this order.
BANK_FEES_FIRST: tuple[str, ...] = (
    r"MasterCard Cross Border",
    r"SALES TAX",
    r"Overdraft",
    r"FEE FOR DDA",
    r"DDA WITHDRAWAL",
)
SUBSCRIPTIONS_FIRST: tuple[str, ...] = (
    r"PAYPAL (?:INST XFER|PURCHASE).*HIDIVE",
    r"PAYPAL (?:INST XFER|PURCHASE).*DISCORD",
    r"PAYPAL (?:INST XFER|PURCHASE).*TWITCH",
    r"PAYPAL.*CLOCKWOR",
    r"PAYPAL.*SHRIKELI",
)
