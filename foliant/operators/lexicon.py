"""The page classifier's lexicon: fixed values, in tie-break order. A regular expression's match is worth 8."""

KEYWORDS: dict[str, dict[str, int]] = {
    "invoice": {
        "invoice": 5, "tax invoice": 8, "invoice number": 7, "invoice no": 7, "gst": 5, "gstin": 7, "bill to": 5, "ship to": 4, "qty": 4, "quantity": 4,
        "amount": 4, "subtotal": 5, "grand total": 8, "total": 4, "hsn": 5, "cgst": 5, "sgst": 5, "igst": 5, "purchase order": 6,
    },
    "bank_statement": {
        "account number": 7, "statement": 5, "withdrawal": 6, "deposit": 6, "balance": 5, "ifsc": 5, "transaction": 5, "credit": 5, "debit": 5,
        "opening balance": 7, "closing balance": 7, "bank statement": 8, "available balance": 6,
    },
    "certificate_of_analysis": {
        "certificate of analysis": 15, "coa": 8, "product name": 7, "lot no": 7, "batch no": 7, "mfg date": 7, "exp date": 7, "specification": 6,
        "physical state": 5, "specific gravity": 5, "acid value": 5, "peroxide value": 5, "iodine value": 5, "pesticide": 5, "heavy metal": 5,
        "arsenic": 5, "cadmium": 5, "lead": 5, "mercury": 5,
    },
    "prescription": {
        "rx": 8, "prescription": 8, "tablet": 5, "capsule": 5, "doctor": 4, "patient": 4, "dosage": 6, "medicine": 5, "drug": 5, "mg": 3, "ml": 3, "bp": 3,
        "diagnosis": 5, "take once daily": 6,
    },
    "lab_report": {
        "lab report": 8, "haemoglobin": 7, "hemoglobin": 7, "wbc": 7, "rbc": 7, "platelet": 7, "blood sugar": 6, "test result": 5, "reference range": 7,
        "pathology": 6, "specimen": 5, "biochemistry": 5, "test name": 5,
    },
    "discharge_summary": {
        "discharge summary": 10, "admission date": 6, "discharge date": 6, "hospital": 4, "patient name": 4, "clinical summary": 7, "diagnosis": 5,
        "treatment": 5, "medical history": 5, "chief complaints": 6,
    },
    "insurance_form": {
        "insurance": 8, "claim": 8, "policy number": 7, "insured": 6, "claim form": 8, "member id": 5, "tpa": 5, "sum insured": 7, "cashless": 6,
    },
    "id_card": {
        "government of india": 10, "aadhaar": 10, "uid": 8, "dob": 5, "male": 3, "female": 3, "identity": 5, "year of birth": 5,
    },
}
PATTERNS: dict[str, tuple[str, ...]] = {
    "invoice": (r"invoice\s*(number|no|#)", "gstin", r"po\s*(number|no)", r"tax\s*invoice"),
    "bank_statement": (r"account\s*(number|no)", "ifsc", r"txn\s*(id|ref)", r"available\s*balance"),
    "certificate_of_analysis": (r"certificate\s*of\s*analysis", r"lot\s*no", r"batch\s*no", r"mfg\s*date", r"exp\s*date"),
    "prescription": (r"\d+\s*mg", r"\d+\s*ml", r"tab\.", r"cap\.", "rx"),
    "lab_report": (r"reference\s*range", r"test\s*name", r"result\s*unit", "haemoglobin", "hemoglobin"),
    "discharge_summary": (r"date\s*of\s*admission", r"date\s*of\s*discharge", r"clinical\s*summary"),
    "insurance_form": (r"policy\s*(number|no)", r"claim\s*(id|number)", r"member\s*id"),
    "id_card": (r"\d{4}\s\d{4}\s\d{4}", r"government\s*of\s*india"),
}
PATTERN_WEIGHT = 8
