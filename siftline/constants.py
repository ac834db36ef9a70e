"""Fixed values that decide results: names, word lists, patterns and defaults.

Every table here is stated plainly because outputs must equal the published
behaviour of the pipeline; nothing in this module is derived.
"""

# Columns of a raw posting, in declared order.
POSTING_COLUMNS = (
    "job_id", "title", "location", "department", "salary_range",
    "company_profile", "description", "requirements", "benefits",
    "telecommuting", "has_company_logo", "has_questions", "employment_type",
    "required_experience", "required_education", "industry", "function",
    "fraudulent",
)

# Text fields, in concatenation order.
TEXT_FIELDS = ("title", "company_profile", "description", "requirements", "benefits")

CATEGORY_FIELDS = (
    "employment_type", "required_experience", "required_education", "industry", "function",
)
FLAG_FIELDS = ("telecommuting", "has_company_logo", "has_questions")

DROP_COLUMNS = (
    "salary_range", "department", "job_id", "location", "unnamed_0", "_source_file",
)

# Columns that identify a posting when sources are merged.
DEDUP_KEY = (
    "title", "location", "requirements", "employment_type", "industry", "function",
    "fraudulent",
)


MISSING = "<missing>"
MAX_FIELD_CHARS = 5000

# Phrases counted as features.
SCAM_TERMS = (
    "wire transfer", "quick money", "urgent hire", "limited time", "send resume",
    "ssn", "background check", "processing fee", "bank account", "credit card",
)

# Phrases that mark a chat message as a pasted posting.
POSTING_KEYWORDS = (
    "job description", "we're hiring", "we are hiring", "position", "role",
    "responsibilities", "requirements", "experience", "qualifications",
    "about the job", "about the role", "tech stack", "looking for",
    "years of experience", "full-time", "part-time", "remote", "salary",
)
POSTING_MIN_CHARS = 200

# Masking patterns, applied in this order.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(?:(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)?\d{3}[\s.-]?\d{4})"
EMAIL_MASK = "[REDACTED_EMAIL]"
PHONE_MASK = "[REDACTED_PHONE]"
PAYLOAD_CHARS = 800


# Unicode white space as one explicit class, so that every regex engine agrees.
WS = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
# The same characters as text.
WS_CHARS = "".join(
    map(
        chr,
        (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000),
    )
)
# Same class, negated.
NOT_WS = "[^" + WS[1:]

# Words of two or more letters, marks, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]{2,}"

# Named character references decoded by the native HTML path (`amp` goes last).
HTML_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "euro": "€", "pound": "£", "amp": "&",
}

# Text features.
NGRAM_RANGE = (1, 2)
MIN_DF = 3
MAX_DF = 0.9
MAX_VOCABULARY = 100_000

# Splits.
SPLIT_SHARES = (0.70, 0.15, 0.15)
SPLIT_SEED = 42

# Decision policy.
GRAY_WIDTH = 0.1
POSITIVE, NEGATIVE, REVIEW = "fraud", "legit", "review"
REVIEWER_LABELS = ("fraud", "legit", "unsure")

# Evaluation.
METRICS = ("f1", "precision", "recall", "roc_auc", "pr_auc", "brier")
ECE_BINS = 15
SCORE_BINS = 30
LENGTH_BINS = 60
SLICE_MIN_COUNT = 30
SWEEP_POINTS = tuple(round(0.05 * i, 2) for i in range(1, 20))

# Model grids.
LOGREG_CS = (0.1, 1.0, 10.0)
SVM_CS = (0.1, 0.5, 1.0, 3.0, 5.0, 10.0, 30.0)
LOGREG_L2_ITER, LOGREG_L1_ITER, SVM_ITER = 500, 3000, 2000
BOOST_TABULAR = {"num_leaves": [64], "max_depth": [-1], "learning_rate": [0.05],
                 "n_estimators": [800], "subsample": [0.9], "colsample": [0.9]}
BOOST_CHILD_ROWS, BOOST_GAMMA, BOOST_PATIENCE = 20, 0.2, 50
BOOST_FULL = {
    "max_depth": [4, 6, 8],
    "learning_rate": [0.05, 0.03, 0.02],
    "n_estimators": [600, 800, 1000],
    "subsample": [0.9],
    "colsample": [0.9],
    "min_child_weight": [1, 5, 10],
    "reg_alpha": [0.0, 0.1, 0.3],
    "reg_lambda": [1.0, 2.0, 5.0],
    "pos_weight_factor": [0.7, 1.0, 1.3],
}
BOOST_MAX_VARIANTS = 12
SEARCH_C_RANGE = (0.01, 100.0)

BENCH_SIZES = (1, 8, 32, 128)
BENCH_REPEATS = 3
MAX_FEEDBACK_BATCH = 100
RETRAIN_MIN_ROWS, RETRAIN_DAYS = 50, 7
DRIFT_ALPHA, SLICE_ALERT_GAP, SHADOW_GAIN = 0.01, 0.1, 0.02

RUN_COLUMNS = (
    "timestamp", "model_name", "model_type", "calibration_method", "threshold",
    "val_f1", "val_precision", "val_recall", "test_f1", "test_precision",
    "test_recall", "config_hash",
)

# Fixed sentences of the explanations.
FRAUD_CLAUSE = " pushed the score toward fraud"
LEGIT_CLAUSE = " reinforced the legit decision"
NO_DRIVERS = "No strong drivers were found for this decision."
NOT_LINEAR = "Explanation available for linear models with accessible coefficients."
