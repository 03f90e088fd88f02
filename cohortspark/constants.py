"""Fixed domain values.

Everything in this file is a fixed value: the lists, lookup tables, patterns and
thresholds that the results depend on. They are written out as plain text and
are the only place where such values live.
"""

# --- Fixed values: variant filter ------------------------------------------
KEEP_VARIANTS = (
    "Missense_Mutation",
    "Nonsense_Mutation",
    "Frame_Shift_Del",
    "Frame_Shift_Ins",
    "Splice_Site",
    "Splice_Region",
    "In_Frame_Del",
    "In_Frame_Ins",
    "Nonstop_Mutation",
)

# --- Fixed values: genes dropped as sequencing artefacts --------------------
ARTEFACT_GENES = ("TTN", "MUC16", "MUC4", "OBSCN", "XIRP2")

# --- Fixed values: genes with a targeted therapy ----------------------------
TARGETABLE_GENES = (
    "EGFR", "ERBB2", "ERBB3", "ALK", "ROS1", "RET", "NTRK1", "NTRK2", "NTRK3",
    "BRAF", "KRAS", "NRAS", "HRAS", "NF1", "MAP2K1", "MAP2K2",
    "FGFR1", "FGFR2", "FGFR3", "FGFR4",
    "MET", "KIT", "PDGFRA", "PDGFRB",
    "PIK3CA", "PIK3R1", "AKT1", "PTEN", "TSC1", "TSC2", "MTOR",
    "CDK4", "CDK6", "CCND1",
    "BRCA1", "BRCA2", "ATM", "PALB2", "CDK12", "CHEK2",
    "IDH1", "IDH2", "FLT3", "VHL", "PBRM1", "BAP1",
    "MLH1", "MSH2", "MSH6", "PMS2",
    "SMO", "PTCH1", "JAK1", "JAK2", "ABL1",
    "POLE", "ARID1A", "SMARCA4", "KDR",
)

# --- Fixed values: genes that get a classifier of their own -----------------
TOP_GENES = ("PIK3CA", "PTEN", "ARID1A", "KRAS", "BRAF", "NF1", "ATM", "IDH1", "BRCA2", "EGFR")

# --- Fixed values: cohorts that get a classifier of their own ---------------
MODEL_COHORTS = {
    "TCGA-BH": "BRCA (breast)",
    "TCGA-CV": "HNSC (head/neck)",
    "TCGA-AA": "COAD (colon)",
    "TCGA-HT": "LGG (brain)",
}

# --- Fixed values: gene to drug --------------------------------------------
DRUG_MAP = {
    "EGFR": "Osimertinib",
    "BRAF": "Vemurafenib",
    "KRAS": "Sotorasib",
    "ALK": "Alectinib",
    "BRCA1": "Olaparib",
    "BRCA2": "Olaparib",
    "PIK3CA": "Alpelisib",
    "ERBB2": "Trastuzumab",
    "IDH1": "Ivosidenib",
    "IDH2": "Enasidenib",
    "FGFR1": "Erdafitinib",
    "FGFR2": "Erdafitinib",
    "FGFR3": "Erdafitinib",
    "FGFR4": "Erdafitinib",
    "MET": "Capmatinib",
    "RET": "Selpercatinib",
    "ROS1": "Crizotinib",
    "NTRK1": "Larotrectinib",
    "NTRK2": "Larotrectinib",
    "NTRK3": "Larotrectinib",
    "KIT": "Imatinib",
    "PDGFRA": "Avapritinib",
    "PTEN": "Ipatasertib (investigational)",
    "ATM": "Olaparib (investigational)",
    "ERBB3": "Pertuzumab",
    "CDK4": "Palbociclib",
    "CDK6": "Palbociclib",
    "FLT3": "Midostaurin",
    "JAK2": "Ruxolitinib",
    "ABL1": "Imatinib",
    "SMO": "Vismodegib",
    "MTOR": "Everolimus",
    "VHL": "Belzutifan",
}
DEFAULT_DRUG = "No FDA-approved targeted therapy"

# --- Fixed values: status classes and what follows from them ----------------
TARGETABLE = "Targetable_Mutation"
NON_TARGETABLE = "Non_Targetable_Mutation"
NO_MUTATION = "No_Mutation"
STATUS_ORDER = (TARGETABLE, NON_TARGETABLE, NO_MUTATION)
LABEL_3CLASS = {TARGETABLE: 2, NON_TARGETABLE: 1, NO_MUTATION: 0}
LABEL_BINARY = {TARGETABLE: 1, NON_TARGETABLE: 0, NO_MUTATION: 0}
PREDICTED_POSITIVE = "Targetable_Mutation"
PREDICTED_NEGATIVE = "Non_Targetable"
FOLLOW_UP = {
    TARGETABLE: "URGENT: Refer to oncologist -- targeted therapy indicated",
    NON_TARGETABLE: "MONITOR: Standard-of-care; consider clinical trial",
    NO_MUTATION: "ROUTINE: Standard surveillance protocol",
}
LOW_CONFIDENCE_NOTE = " | LOW CONFIDENCE -- manual review recommended"
FALSE_NEGATIVE = "FALSE_NEGATIVE (Targetable missed)"
FALSE_POSITIVE = "FALSE_POSITIVE (Over-referred)"

# --- Fixed values: thresholds ----------------------------------------------
HYPERMUTATOR_THRESHOLD = 500
LOW_CONFIDENCE_RANGE = (0.4, 0.6)
PRIORITY_WEIGHTS = {"targetable": 0.5, "confidence": 0.3, "burden": 0.2}
GENE_PROBABILITY_MIN = 0.3
GENE_TOP_K = 5
MIN_COHORT_SIZE = 10
MIN_PREVALENCE_COHORT_SIZE = 20
MIN_GENE_POSITIVES = 10
MIN_COHORT_MODEL_SIZE = 30
MIN_COHORT_MODEL_CLASS = 5
MAX_WORDS = 492
TFIDF_MAX_FEATURES = 25_000
TFIDF_MIN_DF = 3
TFIDF_MAX_DF = 0.95
NGRAM_RANGE = (1, 3)
TEST_FRACTION = 0.2
CV_FOLDS = 5
SEED = 42

# --- Fixed values: identifier patterns --------------------------------------
ID_LENGTH = 12
COHORT_LENGTH = 7
ID_CAPTURE = r"(TCGA-[A-Z0-9]+-[A-Z0-9]+)"
ID_IN_BARCODE = r"^(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4,})-"
ID_FORMAT = r"TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}"

# --- Fixed values: abbreviation (whole word, lower case) to expansion --------
MEDICAL_ABBREVIATIONS = {
    "adenoca": "adenocarcinoma",
    "scc": "squamous cell carcinoma",
    "mets": "metastasis",
    "lvi": "lymphovascular invasion",
    "dz": "disease",
    "hx": "history",
    "dx": "diagnosis",
    "tx": "treatment",
    "pni": "perineural invasion",
    "ca": "carcinoma",
    "bx": "biopsy",
    "pathol": "pathological",
    "rt": "radiation therapy",
    "chemo": "chemotherapy",
    "neoadj": "neoadjuvant",
    "adj": "adjuvant",
    "hem": "hematoxylin",
}

# --- Fixed values: boilerplate, with {d} a digit and {s} a space character ---
BOILERPLATE_PATTERNS = (
    "report generated.*",
    "electronic signature.*",
    "electronically signed.*",
    "this report was generated.*",
    "end of report.*",
    r"pathology report.*page \d+.*",
    "printed on.*",
    "disclaimer:.*",
    "this is a confidential.*",
    r"copy\s*no\.?\s*\d+",
    r"page\s*\d+\s*/\s*\d+",
)

# --- Fixed values: TF-IDF token, on cleaned text ----------------------------
TOKEN_PATTERN = r"\b[a-z][a-z0-9.\-]{1,}\b"

# --- Fixed values: spellings that delimited readers take for a missing value -
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
