"""Fixed values.

Everything in this module must keep exactly these values for results to be
right: column names, label sets, limits, messages, mask tokens, patterns.
"""

# --- feedback table ---------------------------------------------------------
REQUIRED_COLUMNS = ("feedback_id", "feedback_text")
OPTIONAL_COLUMNS = ("source", "date", "rating", "user_type", "region", "product_area", "language")
FEEDBACK_COLUMNS = REQUIRED_COLUMNS + OPTIONAL_COLUMNS
COLUMN_ALIASES = {
    "feedback_id": ("feedback_id", "id", "review_id", "ticket_id"),
    "feedback_text": ("feedback_text", "feedback", "review", "comment", "text", "message"),
    "source": ("source", "channel", "origin"),
    "date": ("date", "created_at", "timestamp"),
    "rating": ("rating", "score", "stars"),
    "user_type": ("user_type", "segment", "customer_segment"),
    "region": ("region", "location", "city", "state"),
    "product_area": ("product_area", "category", "feature_area"),
    "language": ("language", "lang"),
}
MIN_RATING, MAX_RATING = 1.0, 5.0
MAX_CSV_BYTES = 10 * 1024 * 1024

# --- closed label sets ------------------------------------------------------
SENTIMENTS = ("positive", "neutral", "negative", "mixed", "unknown")
SEVERITIES = ("low", "medium", "high", "critical")
INTENTS = ("complaint", "praise", "question", "request", "bug_report", "unknown")
REVIEW_STATUSES = ("pending", "approved", "rejected", "needs_more_evidence")
REVIEW_STATUS_LABELS = {
    "pending": "Pending",
    "approved": "Approved",
    "rejected": "Rejected",
    "needs_more_evidence": "Needs more evidence",
}
ANALYSIS_METHODS = ("local_rule_based", "keyword_rule", "tfidf_fallback", "exploratory_cluster", "unknown")
EVIDENCE_STRENGTHS = ("weak", "moderate", "strong")
SEVERITY_SCORES = {"low": 1, "medium": 2, "high": 4, "critical": 5, "unknown": 1}
UNCOUNTED_THEMES = ("unknown", "other")

# --- scoring ----------------------------------------------------------------
PHRASE_WEIGHT, KEYWORD_WEIGHT = 2.0, 1.0
PRIMARY_MIN_CONFIDENCE = 0.35
SECONDARY_MIN_CONFIDENCE = 0.25
FALLBACK_MIN_SIMILARITY = 0.12
FALLBACK_MAX_CONFIDENCE = 0.55
REVIEW_BELOW_CONFIDENCE = 0.4
TFIDF_VOCABULARY = 5000
CLUSTER_SEED, CLUSTER_RESTARTS, CLUSTER_DEFAULT_K, CLUSTER_MAX_K, CLUSTER_TERMS = 42, 10, 5, 8, 5
MAX_QUOTES, MAX_QUOTE_CHARS = 3, 220
WEAK_MAX_MENTIONS, MODERATE_MIN_MENTIONS = 2, 3
STRONG_MIN_MENTIONS, STRONG_MIN_CONFIDENCE, STRONG_MIN_SOURCES, STRONG_MIN_QUOTES = 5, 0.5, 2, 2

# --- personal data: (type, regex flags, text before the span, span, text after, priority, ambiguous)
# Priority decides overlaps (lowest first).  Java dialect, Unicode classes on.
PII_PATTERNS = (
    ("UPI", "i", r"(?:(?:UPI\s*ID|VPA|payment\s+address|upi\s+id)\s*[:\-]?\s*)?", r"[a-zA-Z0-9._-]+@(?:upi)", r"\b", 10, False),
    ("EMAIL", "", r"\b", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"\b", 20, False),
    ("PHONE", "", r"(?<!\d)", r"(?:\+91[\s-]?|0)?[6-9]\d{9}", r"(?!\d)", 30, False),
    ("CARD", "i", r"(?:card\s+(?:ending\s+)?|ending\s+)", r"(?:\d{4}[\s-]?){3}\d{4}", r"\b", 35, False),
    ("AADHAAR", "i", r"(?:aadhaar|aadhar|uid|identity\s+number)\s*[:\-#]?\s*", r"\d{4}[\s-]?\d{4}[\s-]?\d{4}", r"\b", 40, False),
    ("AADHAAR", "", r"\b", r"\d{4}[\s-]\d{4}[\s-]\d{4}", r"(?![\s-]?\d)\b", 41, True),
    ("ACCOUNT", "i", r"(?:account|a/c|bank\s+account|account\s+number)\s*(?:number|no\.?|#)?\s*[:\-]?\s*", r"\d{8,18}", r"\b", 50, False),
    ("TRANSACTION_ID", "i", r"(?:transaction|txn|reference|ref|payment\s+id)\s*[:\-#]?\s*", r"[A-Z0-9-]{6,}", r"\b", 60, False),
    ("TRANSACTION_ID", "i", r"\b", r"TXN[A-Z0-9-]{6,}", r"\b", 61, False),
    ("TRANSACTION_ID", "i", r"\b", r"REF-\d{4}-\d{4,}", r"\b", 62, False),
    ("CARD", "", r"\b", r"(?:\d{4}[\s-]?){3}\d{4}", r"\b", 71, True),
    ("PAN", "i", r"(?:PAN|permanent\s+account\s+number)\s*[:\-#]?\s*", r"[A-Z]{5}\d{4}[A-Z]", r"\b", 80, False),
    ("PAN", "", r"\b", r"[A-Z]{5}\d{4}[A-Z]", r"\b", 81, True),
)
PII_TYPES = ("EMAIL", "PHONE", "UPI", "AADHAAR", "ACCOUNT", "TRANSACTION_ID", "CARD", "PAN")
GATE_TYPES = ("EMAIL", "PHONE", "UPI")
FORBIDDEN_EXPORT_COLUMNS = ("original_text", "feedback_text")

# --- messages ---------------------------------------------------------------
MSG_EMPTY_ID = "feedback_id is empty."
MSG_EMPTY_TEXT = "feedback_text is empty or whitespace-only."
MSG_DUP_ID = "Duplicate feedback_id detected."
MSG_DUP_TEXT = "Duplicate feedback_text detected."
MSG_PII_MISSING = "Input text is missing."
MSG_SENTIMENT_MISSING = "Input text is missing; sentiment set to unknown."
MSG_THEME_MISSING = "Input text is missing; theme set to unknown."
MSG_NO_THEME_EVIDENCE = "No reliable theme evidence found."
MSG_NO_THEME = "No reliable theme identified."
MSG_FALLBACK = "Theme assigned via exploratory TF-IDF fallback."
MSG_MASKED_MISSING = "Masked text is missing."
MSG_PII_REVIEW = "PII review flagged on source row."
MSG_CLUSTER = "Exploratory similarity group — not a confirmed product theme."
MSG_CLUSTER_NO_TEXT = "Clustering skipped: no usable masked text."
MSG_CLUSTER_SINGLE = "Clustering skipped for single-record dataset; assigned exploratory cluster 0."
MSG_CLUSTER_NO_TERMS = "Clustering skipped: empty TF-IDF vocabulary."
MSG_CLUSTER_REDUCED = "Requested cluster count reduced to match usable record count."
MSG_ANALYSIS_EMPTY = "Empty DataFrame received; no records analysed."
MSG_ANALYSIS_DUPLICATES = "Duplicate feedback_id values detected; results retained for all rows."
MSG_AGGREGATE_EMPTY = "Empty feedback DataFrame received; no theme insights generated."
MSG_NEEDS_MASKED_ANALYSIS = (
    "Analysis requires a 'masked_text' column. Run PII masking before analysis. "
    "Raw 'feedback_text' or 'original_text' must not be analysed directly."
)
MSG_NEEDS_MASKED_THEMES = (
    "Theme aggregation requires a 'masked_text' column. Use PII masking before aggregation."
)
MSG_FEW_RECORDS = "Fewer than 3 supporting records; evidence strength is limited."
MSG_NO_QUOTES = "No valid masked representative quotes available."
MSG_QUOTE_NO_ID = "Quote is missing a feedback ID."
MSG_QUOTE_NO_SOURCE = "Feedback ID was not found in the masked feedback DataFrame."
MSG_QUOTE_NO_TEXT = "Masked text is missing for the referenced feedback ID."
MSG_QUOTE_EMPTY = "Quote text is empty."
MSG_QUOTE_NOT_EXCERPT = "Quote is not an exact masked_text match or contiguous excerpt."
MSG_QUOTE_NOT_SUPPORTING = "Quote does not support the associated theme."
MSG_QUOTE_VALID = "Quote validated against masked_text."
OBSERVED, INTERPRETED, SUGGESTED = "Observed evidence: ", "Possible interpretation: ", "Suggested action: "
MENTIONED = " feedback record(s) mention "
QUOTES_TO_REVIEW = " quote(s) require review before use as evidence."
GENERIC_EXPLANATION = "Customers are repeatedly reporting issues related to "
ORPHAN_BEFORE, ORPHAN_AFTER = "Analysis result for feedback_id '", "' excluded: ID not found in masked feedback DataFrame."
GENERIC_ROOT_CAUSE = "Repeated masked feedback patterns suggest a recurring customer-facing issue."
ROOT_CAUSE_CAVEAT = "This is a suggested interpretation and requires PM validation."
GENERIC_ACTION = "Review supporting masked feedback and validate the next product investigation step."
ACTION_CAVEAT = "This is a suggested action, not a confirmed product decision."
PRIORITY_METHOD = "frequency_x_severity_x_confidence"
PRIORITY_WARNING = "Prototype prioritization score – requires PM judgment."
WARN_WEAK = "Evidence strength is weak — treat findings cautiously."
WARN_LOW_CONFIDENCE = "Average confidence is low — classification may be unreliable."
WARN_FEW = "Fewer than three supporting records — sample may be too small."
DISCLAIMER = (
    "Results describe patterns in the uploaded dataset only. Suggested actions are prototype outputs "
    "and require product-manager validation."
)

# --- the Markdown report: headings and labels that readers of the file rely on ---
REPORT = {
    "title": "# Voice-of-Customer Executive Report",
    "generated": "**Report generated:**",
    "summary": "## Dataset Summary",
    "records": "- **Total feedback records (uploaded):**",
    "analyzed": "- **Valid records analyzed:**",
    "themes": "- **Total theme insights:**",
    "overview": "## Theme Insights Overview",
    "overview_columns": "| Theme | Priority | Mentions | Primary | Secondary | % Feedback | Evidence Strength | Status |",
    "overview_rule": "|---|---|---|---|---|---|---|---|",
    "details": "## Detailed Theme Breakdown",
    "score": "- **Priority Score:**",
    "components": "  - Components: Frequency=%s, Severity=%s, Confidence=%s",
    "mentions": "- **Mention Count:** %d (Primary: %d, Secondary: %d)",
    "percentage": "- **Feedback Percentage:**",
    "strength": "- **Evidence Strength:** %s (Confidence: %s)",
    "status": "- **Review Status:**",
    "note": "- **Reviewer Note:**",
    "ids": "- **Supporting Feedback IDs:**",
    "no_ids": "None",
    "quotes": "- **Validated Masked Quotes:**",
    "causes": "- **Possible Root Causes (PM Validation Required):**",
    "actions": "- **Suggested Product Actions (Suggestions Only):**",
    "methods": "## Methodology & Limitations",
    "method_notes": (
        "- Themes come from keyword rules, with TF-IDF similarity where no rule is sure enough.",
        "- All figures describe the records of this run and nothing else.",
        "- The priority score multiplies how often, how severe and how certain.",
    ),
    "privacy": "## Privacy Statement",
    "privacy_note": "Only masked texts are exported; the write stops at the first readable personal detail.",
}
