"""Word lists, thresholds and phrases the operators take as defaults.

Everything in this file is a FIXED VALUE: the lists decide which rows match, so
they are stated plainly and in order.  Operators accept them as parameters, so
another domain can bring its own lists.
"""

# Raw list-valued columns and the eight fields completeness counts.
LIST_FIELDS = ["specialties", "procedure", "equipment", "capability"]
KEY_FIELDS = [
    "description", "specialties", "equipment", "procedure", "capability",
    "numberDoctors", "capacity", "facilityTypeId",
]
MISSING_MARKERS = ["null", "[]", "", "None"]

# Specialties of the coverage grid and their keywords.
GAP_SPECIALTIES = {
    "oncology": ["oncology", "cancer", "chemotherapy", "radiotherapy"],
    "dialysis": ["dialysis", "nephrology", "kidney", "renal"],
    "neonatal_icu": ["neonatal", "nicu", "newborn icu", "paediatric icu"],
    "emergency_trauma": ["emergency", "trauma", "casualty", "accident"],
    "mental_health": ["psychiatry", "mental health", "psychology", "behavioural"],
    "obstetrics": ["obstetrics", "gynaecology", "maternity", "delivery"],
}

# Evidence words a claim must show in the source text.
STANDARDS = {
    "has_icu": ["icu", "intensive care", "critical care", "ventilator", "intensivist"],
    "has_emergency": ["emergency", "a&e", "trauma", "urgent care", "casualty", "24/7",
                      "round the clock"],
    "has_surgery": ["operation theatre", "ot ", "surgeon", "surgical", "surgery"],
    "has_24_7": ["24/7", "24 hours", "round the clock", "always open", "day and night"],
}

# Words that state each of the nine claims.
CLAIMS = {
    "has_icu": STANDARDS["has_icu"],
    "has_emergency": STANDARDS["has_emergency"],
    "has_24_7": STANDARDS["has_24_7"],
    "has_surgery": STANDARDS["has_surgery"],
    "has_dialysis": GAP_SPECIALTIES["dialysis"],
    "has_oncology": GAP_SPECIALTIES["oncology"],
    "has_neonatal_icu": GAP_SPECIALTIES["neonatal_icu"],
    "has_mental_health": GAP_SPECIALTIES["mental_health"],
    "has_trauma_centre": ["trauma", "casualty"],
}

# Equipment and procedure words looked for in free text.
EQUIPMENT_WORDS = ["ventilator", "monitor", "oxygen", "mri", "ct scan", "x-ray", "ultrasound"]
PROCEDURE_WORDS = ["dialysis", "surgery", "delivery", "chemotherapy", "radiotherapy", "endoscopy"]

# Words of the consistency rules.
ANAESTHETIST_WORDS = ["anaesthesiologist", "anesthesiologist", "anaesthetist", "anesthesia"]
LIMITED_HOURS_WORDS = ["closes", "closed at", "10pm", "8pm", "9pm", "hours only",
                       "outpatient only"]
ICU_EVIDENCE_WORDS = ["ventilator", "icu", "intensive care", "oxygen", "monitor"]
TEAM_WORDS = ["team of", "50 specialists", "specialists available"]

# Words a search ignores, and words that ask for disputed facilities.
STOP_WORDS = [
    "care", "clinic", "clinics", "hospital", "hospitals", "medical", "health",
    "centre", "center", "centers", "services", "service", "department", "unit",
    "find", "need", "want", "best", "good", "near", "india", "with", "that",
    "have", "their", "from", "this", "show", "give", "list", "looking",
    "claiming", "contradictions", "contradiction", "disputes", "disputed",
    "verified", "unverified", "flagged", "suspicious",
]
CONTRADICTION_TRIGGERS = ["contradiction", "contradictions", "dispute", "disputed",
                          "discrepancy", "claiming"]

# Phrases that mark a question about coverage gaps.
GAP_PHRASES = [
    "states have no", "states with no", "states lack", "states without",
    "states don't have", "states do not have", "states missing",
    "no dialysis", "no icu", "no emergency", "no hospital", "no centre", "no center",
    "no psychiatric", "no cancer", "no maternity", "no trauma",
    "desert", "gap in", "underserved", "no facility", "no facilities",
    "lack of", "lacking", "shortage of", "shortages",
    "absent", "unavailable", "unserved", "uncovered",
]

# Word prefix -> specialty patterns.
SPECIALTY_PREFIXES = {
    "dialysis": ["dialysis", "nephrology"],
    "kidney": ["dialysis", "nephrology"],
    "renal": ["dialysis", "nephrology"],
    "mental": ["psychiatry", "mental health", "psychology"],
    "psychiatry": ["psychiatry", "mental health"],
    "psychiatric": ["psychiatry", "mental health"],
    "trauma": ["emergency", "trauma"],
    "emergency": ["emergency", "trauma"],
    "cancer": ["oncology"],
    "oncology": ["oncology"],
    "heart": ["cardiology"],
    "cardiac": ["cardiology"],
    "cardiology": ["cardiology"],
    "maternity": ["obstetrics", "gynecology"],
    "obstetric": ["obstetrics", "gynecology"],
    "gynecology": ["gynecology", "obstetrics"],
    "eye": ["ophthalmology"],
    "ophthal": ["ophthalmology"],
    "bone": ["orthopedics"],
    "joint": ["orthopedics"],
    "ortho": ["orthopedics"],
    "surgery": ["surgery"],
    "surgical": ["surgery"],
    "icu": ["critical care", "icu"],
    "critical": ["critical care"],
    "child": ["pediatrics"],
    "pediatric": ["pediatrics"],
}

# Map legend groups, query languages, facility types, known states.
MAP_GROUPS = {
    "Emergency Trauma": ["emergency", "trauma", "casualty"],
    "Oncology": ["oncology", "cancer", "chemotherapy"],
    "Dialysis / Nephrology": ["dialysis", "nephrology", "kidney", "renal"],
    "Neonatal ICU": ["neonatal", "nicu", "paediatric icu"],
    "Cardiology": ["cardiology", "cardiac", "heart"],
    "Mental Health": ["mental health", "psychiatry", "psychology"],
    "Obstetrics": ["obstetrics", "gynaecology", "maternity", "delivery"],
}
TRANSLATED_LANGUAGES = ["hi-IN", "ur-PK", "hi", "ur"]
FACILITY_TYPES = ["hospital", "clinic", "dentist", "doctor", "pharmacy"]
DEFAULT_LAT, DEFAULT_LNG = 20.5, 78.9

# Clinical category of a readable specialty label.
SPECIALTY_CATEGORIES = {
    "oncology": "High-Acuity",
    "nephrology": "High-Acuity",
    "emergency medicine": "High-Acuity",
    "neonatology": "High-Acuity",
    "cardiology": "High-Acuity",
    "critical care": "High-Acuity",
    "psychiatry": "Primary Care",
    "family medicine": "Primary Care",
    "pediatrics": "Primary Care",
    "ophthalmology": "Surgical",
    "general surgery": "Surgical",
    "orthopedics": "Surgical",
    "radiology": "Diagnostic",
    "pathology": "Diagnostic",
}
