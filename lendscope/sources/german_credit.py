"""Column names, feature groups and code labels of the German credit loan
table (the reference workflow's input layout).

Fixed values, as published with that data set (kept in their natural order).
"""

# Raw (German) column name -> English name.
COLUMN_MAPPING = {
    "laufkont": "checking_account",
    "laufzeit": "duration_months",
    "moral": "credit_history",
    "verw": "purpose",
    "hoehe": "credit_amount",
    "sparkont": "savings_account",
    "beszeit": "employment_years",
    "rate": "installment_rate",
    "famges": "personal_status",
    "buerge": "other_debtors",
    "wohnzeit": "residence_years",
    "verm": "property",
    "alter": "age",
    "weitkred": "other_installments",
    "wohn": "housing",
    "bishkred": "existing_credits",
    "beruf": "job",
    "pers": "dependents",
    "telef": "telephone",
    "gastarb": "foreign_worker",
    "kredit": "target",
}

# Feature groups.
NUMERIC_COLS = ["duration_months", "credit_amount", "age", "installment_rate", "residence_years",
                "existing_credits", "dependents"]
CATEGORICAL_COLS = ["checking_account", "credit_history", "purpose", "savings_account", "employment_years",
                    "personal_status", "other_debtors", "property", "other_installments", "housing", "job",
                    "telephone", "foreign_worker"]
SELECTED_NUMERIC = ["duration_months", "credit_amount", "age", "installment_rate"]
SELECTED_CATEGORICAL = ["checking_account", "credit_history", "purpose", "savings_account", "employment_years",
                        "personal_status", "other_debtors", "property", "other_installments", "housing",
                        "foreign_worker"]

# Defaults used for features an applicant form does not ask for.
HIDDEN_DEFAULTS = {"other_debtors": 1, "property": 2, "foreign_worker": 2}

# Code -> readable label per categorical column.
LABEL_MAPS = {
    "checking_account": {1: "< 0 DM (negative)", 2: "0–200 DM", 3: "> 200 DM", 4: "No account"},
    "credit_history": {0: "No credits taken", 1: "All credits paid duly", 2: "Existing credits paid duly",
                       3: "Delay in past", 4: "Critical account"},
    "purpose": {0: "New car", 1: "Used car", 2: "Furniture/equipment", 3: "Radio/TV", 4: "Appliances",
                5: "Repairs", 6: "Education", 7: "Vacation", 8: "Retraining", 9: "Business", 10: "Other"},
    "savings_account": {1: "< 100 DM", 2: "100–500 DM", 3: "500–1000 DM", 4: "> 1000 DM", 5: "Unknown/None"},
    "employment_years": {1: "Unemployed", 2: "< 1 year", 3: "1–4 years", 4: "4–7 years", 5: "> 7 years"},
    "personal_status": {1: "Male: divorced/separated", 2: "Female: divorced/separated/married",
                        3: "Male: single", 4: "Male: married/widowed"},
    "other_debtors": {1: "None", 2: "Co-applicant", 3: "Guarantor"},
    "property": {1: "Real estate", 2: "Savings/insurance", 3: "Car or other", 4: "Unknown/None"},
    "other_installments": {1: "Bank", 2: "Stores", 3: "None"},
    "housing": {1: "Rent", 2: "Own", 3: "Free"},
    "job": {1: "Unemployed/unskilled (non-resident)", 2: "Unskilled (resident)", 3: "Skilled employee",
            4: "Management/self-employed"},
    "telephone": {1: "None", 2: "Yes (registered)"},
    "foreign_worker": {1: "Yes", 2: "No"},
}

# Target labels (0 = good, 1 = default).
TARGET_LABELS = {0: "Good", 1: "Default"}
