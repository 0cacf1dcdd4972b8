"""Patterns, word lists, limits and texts that results depend on."""

# White space trimmed from both ends of a text (Unicode White_Space).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Document types.
CSV, JSON, LOG, KEY_VALUE, MARKDOWN, XML, UNKNOWN = (
    "csv", "json", "log", "key_value", "markdown", "xml", "unknown",
)

# Line patterns for document types.
LOG_LINE = r"^\[?\d{4}[-/]\d{2}[-/]\d{2}[T ]?\d{2}:\d{2}"
XML_TAG = r"<[a-zA-Z][^>]*>"
KEY_VALUE_LINE = r"^[A-Za-z][A-Za-z0-9 _-]*:\s+\S"
MARKDOWN_HEADING = r"^#{1,6}\s+\S"
# First lines that decide a type where a window is asked for: for logs and headings, for key-value lines.
TYPE_WINDOW = (20, 30)

# Value patterns for field types.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://"
DATE = (
    r"^\d{4}[-/]\d{2}[-/]\d{2}|^\d{2}[-/]\d{2}[-/]\d{4}"
    r"|^\d{2}-[A-Za-z]{3}-\d{4}|^[A-Za-z]+ \d{1,2},? \d{4}"
)
NUMBER = (
    r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    r"|^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$|^[nN][aA][nN]$"
    r"|^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+$"
)
CURRENCY_CELL = r"^\$[\d,.]+$|^€[\d,.]+$|^£[\d,.]+$"
MISSING_TOKENS = ("", "null", "n/a", "not_available")

# Lines that suggest numbers worth charting.
CHART_NUMBER = r"\$[\d,.]+|(?<![0-9A-Za-z_])\d{2,}(?![0-9A-Za-z_])"

# Retrieval.
TOKEN = r"[a-z0-9]+"
CHUNK_BYTES = 500
BM25_K1 = 1.2
BM25_B = 0.75

# Previews: characters kept and the marker that follows a cut.
RAW_PREVIEW = 8000
DIGEST_RAW = 2000
CUT_MARKER = "\n... [truncated]"

# Characters stripped from both ends of a word before it is judged significant.
WORD_PUNCTUATION = "\"',;:()[]{}"

# Quality score.
QUALITY_WEIGHTS = {"completeness": 30, "consistency": 25, "validity": 20, "structure": 25}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
LOWEST_GRADE = "F"
ADVICE_PENDING = "Parse the document in Explorer to get a quality score"
ADVICE_INVALID = "Structured output is not valid JSON — re-parse"
ADVICE_COMPLETENESS = "Some fields are null — consider re-parsing with more detail"
ADVICE_CONSISTENCY = "Inconsistent field names across records — normalize schema"
ADVICE_VALIDITY = "Some raw data may not have been captured — review output"
ADVICE_STRUCTURE = "Output structure is flat — consider nested grouping"
ADVICE_GOOD = "Good quality — ready for export and analysis"

# Profile issues and clean-report advice.
ISSUE_NO_SCHEMA = "Schema inference is not available for this document type"
ISSUE_BAD_CSV = "Could not parse CSV"
ISSUE_BAD_JSON = "Could not parse JSON structure"
ISSUE_MIXED = "mixed types detected — inconsistent data"
ADVICE_MISSING = "% missing values — consider imputation or filtering"
ADVICE_MIXED = " — needs type normalization"
ADVICE_CURRENCY = "Found currency-formatted values ($X,XXX) — strip symbols for numerical analysis"
ADVICE_DATES = "Multiple date columns detected — standardize to ISO 8601 format"

# View recommendations.
VIEW_REASONS = {
    "explorer": "Always available",
    "upload_first": "Upload a document first",
    "upload_and_collect": "Upload documents and add to a collection",
    "uploaded": "Document uploaded",
    "tabular": "Tabular data detected",
    "not_tabular": "No tabular data — works best with CSV or JSON arrays",
    "numeric": "Numeric data found",
    "not_numeric": "No numeric data for visualization",
    "many_documents": "Collection has multiple documents — compare and query across them",
    "one_document": "Query across your collection — add more docs to compare",
    "no_documents": "Add documents to a collection first",
}

# Charts.
PIE_SLICES = 8
AXIS_STEPS = 4
OTHER_LABEL = "Other"

# Milestones: action that earns it -> key.
MILESTONES = {
    "upload": "first_upload",
    "save_structured_data": "structured",
    "save_schema": "schema_master",
    "save_summary": "summarizer",
    "query_structured_data": "queried",
}
POWER_USER = "power_user"
POWER_USER_DOCUMENTS = 5

NO_TABULAR_DATA = "no tabular data found"
