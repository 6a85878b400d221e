"""Fixed values.

Everything here must equal the published behaviour for results to agree: regulation wording,
message texts, word lists, unit factors, patterns. They are data, stated once and plainly.
"""

# The mandated health warning (27 CFR 16.21) and its literal header.
WARNING_HEADER = "GOVERNMENT WARNING:"
OFFICIAL_WARNING = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink "
    "alcoholic beverages during pregnancy because of the risk of birth defects. (2) "
    "Consumption of alcoholic beverages impairs your ability to drive a car or operate "
    "machinery, and may cause health problems."
)

# Claims file columns.
REQUIRED_CLAIM_COLUMNS = ["filename", "brand", "alcohol_content"]
OPTIONAL_CLAIM_COLUMNS = ["net_contents", "class_type"]

# Accepted label image extensions and archive limits.
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff"]
CASE_IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg"]
MSG_FILE_LARGE = "too large — 10 MB max per file"
MSG_THREAD_FULL = "this chat has reached its 50 MB upload limit"
MSG_FILE_UNSIZED = "the file's size is not known"
MAX_ARCHIVE_FILES = 25
MAX_MEMBER_BYTES = 10 * 1024 * 1024
MAX_ARCHIVE_BYTES = 50 * 1024 * 1024
MAX_THREAD_BYTES = 50 * 1024 * 1024

# Number patterns of alcohol statements (case-insensitive where written so).
NUMBER_PATTERN = r"\d+(?:\.\d+)?"
ALCOHOL_KEYWORDS = ["alc", "abv", "vol"]
ALCOHOL_WINDOW = 12

# Metric volume units in millilitres.
UNIT_ML = {
    "ml": 1.0, "milliliter": 1.0, "milliliters": 1.0, "millilitre": 1.0, "millilitres": 1.0,
    "cl": 10.0, "centiliter": 10.0, "centiliters": 10.0,
    "dl": 100.0, "deciliter": 100.0, "deciliters": 100.0,
    "l": 1000.0, "liter": 1000.0, "liters": 1000.0, "litre": 1000.0, "litres": 1000.0,
}
NET_PATTERN = (
    r"(?i)(\d+(?:[.,]\d+)?)\s*"
    r"(ml|cl|dl|l|milliliters?|millilitres?|centiliters?|deciliters?|liters?|litres?)\b"
)

# Field labels.
FIELD_LABELS = {
    "brand": "Brand name",
    "alcohol_content": "Alcohol content",
    "government_warning": "Government warning",
    "net_contents": "Net contents",
    "class_type": "Class/type",
}

# Messages of the field matchers.
MSG_NOT_FOUND = "(not found on label)"
MSG_ABV_CLAIM_BAD = "(claimed alcohol content not understood)"
MSG_ABV_MATCH = "matches the claimed alcohol content"
MSG_ABV_DIFFERS = "label alcohol content differs from the application"
MSG_ABV_NONE_FOUND = "(no alcohol content found on label)"
MSG_ABV_NONE_DETAIL = "no alcohol statement detected on the label"
MSG_NET_CLAIM_BAD = "(claimed net contents not understood)"
MSG_NET_MATCH = "matches the claimed net contents"
MSG_NET_DIFFERS = "label net contents differs from the application"
MSG_NET_NONE_FOUND = "(no net contents found on label)"
MSG_NET_NONE_DETAIL = "no net-contents statement detected; deferring to review"
MSG_WARN_ABSENT = "No government warning was found on this label — it appears to be missing."
MSG_WARN_ABSENT_DETAIL = (
    "label read clearly but no 'GOVERNMENT WARNING:' text was detected — "
    "needs a human to confirm it is actually absent"
)
MSG_WARN_UNREAD = "The government warning couldn't be read on this image."
MSG_WARN_UNREAD_DETAIL = (
    "warning text not detected on a low-confidence read — needs a human to verify"
)
MSG_WARN_PASS = "Official warning present (correct wording and ALL CAPS)."
MSG_WARN_CLOSE = (
    "Warning header is correct, but the wording couldn't be read clearly enough to confirm — "
    "please verify by eye."
)
MSG_WARN_WORDING = "Header present, but the wording does not match the official text."
MSG_WARN_CASE = "Warning present but the header is not in the required ALL CAPS."
MSG_WARN_CASE_DETAIL = "expected literal 'GOVERNMENT WARNING:' (all caps)"
MSG_WARN_HEADER = (
    "The government warning header couldn't be read clearly — please verify by eye."
)
MSG_WARN_HEADER_DETAIL = "header region didn't OCR confidently — needs a human to verify"
MSG_UNREADABLE = (
    "Couldn't read this image. Please upload a clearer, well-lit "
    "photo of the label with the text in focus."
)

# Messages of the batch join.
MSG_DUP_WITH_IMAGE = "This filename appears more than once in the CSV — fix the CSV and re-run."
MSG_NO_CLAIM = "No CSV row matches this image's filename."
MSG_DUP_NO_IMAGE = "Duplicate filename in the CSV; no matching image uploaded."
MSG_NO_IMAGE = "The CSV lists this filename but no matching image was uploaded."

# Reviewer reasons: (field, review_kind, status) -> (reason, what to check).
REASONS = [
    ("brand", "", "FLAG",
     "The brand name read from the label isn't a close enough match to the application. Case, "
     "punctuation, and spacing differences are tolerated, so this means the names genuinely "
     "differ (or the brand text didn't scan cleanly).",
     "Compare the brand on the label artwork against the application's brand name."),
    ("alcohol_content", "", "FLAG",
     "The alcohol content on the label doesn't match the application's claimed value. Values "
     "are compared as numbers (5 = 5.0%, and proof = 2× ABV is understood), so this is a "
     "genuine numeric difference.",
     "Read the ABV or proof printed on the label and confirm it equals the application."),
    ("government_warning", "", "FLAG",
     "The Government Warning is readable but does not match the mandated statement — either "
     "the header is not in the required ALL CAPS or the wording differs from the official "
     "§16.21 text.",
     "Compare the label's warning against the verbatim §16.21 statement; the header must be "
     "the literal 'GOVERNMENT WARNING:' in all capital letters."),
    ("government_warning", "", "REVIEW",
     "The Government Warning appears to be present, but it couldn't be read confidently "
     "enough to confirm the exact wording and casing — so it's deferred to a human rather "
     "than passed or failed.",
     "Visually confirm the label carries the exact §16.21 statement with the ALL-CAPS "
     "'GOVERNMENT WARNING:' header."),
    ("government_warning", "absent", "REVIEW",
     "No Government Warning was found on this label, even though the rest of it read clearly "
     "— it appears to be missing. Because the system never confidently fails an item it might "
     "have misread, this is deferred for you to confirm by eye rather than auto-failed.",
     "Confirm by eye whether the label actually carries the §16.21 'GOVERNMENT WARNING:' "
     "statement at all. If it is genuinely absent, the label is non-compliant."),
    ("government_warning", "unreadable", "REVIEW",
     "The Government Warning region didn't read clearly enough to confirm its wording and "
     "casing, so it's deferred to a human rather than passed or failed.",
     "Visually confirm the label carries the exact §16.21 statement with the ALL-CAPS "
     "'GOVERNMENT WARNING:' header."),
]
GENERIC_REVIEW = (
    "This field couldn't be read confidently from the image, so it's deferred to a human "
    "instead of being passed or failed.",
    "Check this field on the label artwork by eye.",
)
GENERIC_FLAG = (
    "This field did not match the application.",
    "Compare this field on the label against the application.",
)
FIELD_CITATIONS = {
    "brand": "27 CFR §4.33 / §5.63 / §7.63 — brand name must appear and match the approved "
             "application.",
    "alcohol_content": "27 CFR §4.36 / §5.65 / §7.65 — alcohol-content statement and its "
                       "tolerances.",
    "government_warning": "27 CFR §16.21 (required statement) and §16.22 (form: literal "
                          "ALL-CAPS 'GOVERNMENT WARNING:').",
}

# Retrieval word lists and constants.
STOPWORDS = [
    "the", "a", "an", "of", "to", "for", "and", "or", "is", "are", "what", "does",
    "do", "need", "needs", "on", "in", "must", "be", "my", "this", "that", "it",
    "how", "can", "i", "with", "as", "at", "by", "if", "show", "me", "tell", "about",
    "who", "where", "when", "which", "put", "apply", "use", "used", "have", "has",
    "make", "made", "get", "take", "should", "may", "will", "would", "there",
]
EXPANSIONS = [
    ("caps", "capital letters"), ("case", "capital letters bold"),
    ("title", "capital letters"), ("uppercase", "capital letters"), ("bold", "bold type"),
    ("header", "capital letters bold"), ("format", "legibility format"),
    ("legible", "legibility"), ("missing", "required statement"),
    ("wording", "exact statement"), ("abv", "alcohol content"),
    ("class", "class type designation"),
]
REFUSAL = "Not found in the regulations on file."
ANSWER_PREAMBLE = "Based only on the regulations on file:\n\n"
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
HEADING_WEIGHT = 3
RRF_C = 60

# Off-corpus probes and threshold grid of the refuse sweep.
OFF_CORPUS_PROBES = [
    "Serving Facts panels on alcohol labels",
    "QR code requirements on labels",
    "pictorial health warnings on bottles",
    "federal excise tax rate",
]
MIN_COVERAGE_GRID = [0.3, 0.4, 0.5, 0.6]
MIN_DENSE_SIM_GRID = [0.55, 0.7, 0.8]

# Audit log layout.
AUDIT_CONTENT = ["ts", "actor", "action", "target_result_id", "old_verdict", "new_verdict",
                 "reason"]
AUDIT_COLUMNS = ["id", *AUDIT_CONTENT, "prev_hash", "row_hash"]
FORMULA_TRIGGERS = "=+-@\t\r"

# Transcript vocabulary.
VERDICT_KEYWORDS = ["PASS", "FLAG", "NEEDS REVIEW"]
VERIFY_TOOLS = ["verify_label", "verify_text", "batch_verify"]
LOOKUP_TOOLS = ["regulatory_lookup", "explain_flag"]
WRITE_TOOLS = ["override_result", "manual_fallback", "batch_verify"]
NEGATION_PATTERN = r"\b(NOT|NO|NONE|NEVER|WITHOUT)\b|N'T"
NEGATION_WINDOW = 25
SCORE_DIMENSIONS = ["faithfulness", "clarity", "actionability", "calibration"]
YES_TOKENS = ["pass", "p", "1", "true", "yes", "ok"]
NO_TOKENS = ["flag", "fail", "f", "0", "false", "no"]
