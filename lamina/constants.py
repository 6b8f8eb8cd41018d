"""Fixed values of the corpus, which decide ids, budgets and texts."""

from __future__ import annotations

# fixed values: topics in their order
TOPICS = [
    "diabetes", "hypertension", "obesity", "hyperlipidemia", "asthma", "copd", "pneumonia", "tuberculosis",
    "coronary artery disease", "heart failure", "stroke", "arrhythmia", "malaria", "dengue fever", "hiv aids",
    "hepatitis b", "covid-19", "typhoid", "depression", "anxiety disorder", "peptic ulcer disease",
    "irritable bowel syndrome", "hepatitis c", "osteoarthritis", "rheumatoid arthritis", "osteoporosis",
    "hypothyroidism", "hyperthyroidism", "epilepsy", "migraine", "parkinson's disease", "chronic kidney disease",
    "breast cancer", "lung cancer", "anemia in pregnancy", "malnutrition",
]

# fixed values: topics served by one guideline document
GUIDELINE_GROUPS = [
    ["tuberculosis"], ["hypertension"], ["diabetes"], ["obesity"], ["pneumonia"], ["covid-19"], ["malaria"],
    ["hiv aids"], ["hepatitis b"], ["hepatitis c"], ["dengue fever"], ["typhoid"], ["malnutrition"],
    ["anemia in pregnancy"], ["breast cancer"], ["asthma", "copd"],
    ["coronary artery disease", "heart failure", "stroke", "hyperlipidemia"],
    ["depression", "anxiety disorder", "epilepsy"],
]

# fixed values: topics searched under another term
SEARCH_TERMS = {"hiv aids": "HIV-1", "peptic ulcer disease": "peptic ulcer"}

# fixed values: abbreviations whose point ends no sentence
ABBREVIATIONS = ["Fig", "Eq", "Ref", "Vol", "e.g", "i.e", "vs", "Dr", "Mr", "Mrs", "et al", "approx", "cf", "mg", "mL", "no", "cm", "kg"]

# fixed values: sections of a drug label in their order
DRUG_SECTIONS = {
    "indications_and_usage": "Indications and Usage",
    "dosage_and_administration": "Dosage and Administration",
    "contraindications": "Contraindications",
    "warnings_and_cautions": "Warnings and Cautions",
    "adverse_reactions": "Adverse Reactions",
    "drug_interactions": "Drug Interactions",
    "mechanism_of_action": "Mechanism of Action",
}

# fixed values: budgets in tokens, caps and limits
ARTICLE_TOKENS = 500
LABEL_TOKENS = 300
GUIDELINE_TOKENS = 300
TABLE_TOKENS = 6000
WINDOW_TOKENS = 7500
WINDOW_FLOOR = 500
BATCH_TOKENS = 250_000
BATCH_CHUNKS = 500
ARTICLES_PER_TOPIC = 130
LABELS_PER_TOPIC = 25
RAW_LABELS_PER_TOPIC = 150
IMAGE_MIN_SIDE = 100
IMAGE_MIN_STD = 5.0
IMAGE_MAX_REPEATS = 3
RASTER_DPI = 150
SECTION_TOKENS = 600
DOLLARS_PER_MILLION = 0.02

# fixed values: expressions
HEADER_FOOTER = r"(.*World Health Organization \(WHO\).*\n?)|(\d+ of \d+)"
FIGURE_CAPTION = r"\b(Fig(?:ure)?\.?\s*\d+|Algorithm\s*\d+)\b"
COVER_PAGE = r"_page0_img0\.png$"
PLAIN_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])"
PARAGRAPH = r"\n\s*\n"
SECTION_HEADER = r"\n(\d+(?:\.\d+){0,3}\s+[A-Z][A-Za-z][^\n]{2,80})\n"
TRAILING_NUMBER = r"\s+\d+$"

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
