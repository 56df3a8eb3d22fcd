"""Fixed values that must equal the analysed application's for identical results.

Everything here is data, not logic: token lists, keyword lists, patterns and
date formats, written out in their natural order. Patterns are Java regular
expressions (Spark's ``rlike``); ``(?U)`` makes ``\\d``, ``\\s`` and ``\\b``
Unicode-aware like Python's ``re`` on text.
"""

# --- fixed values: spreadsheet error cells read as missing -----------------
EXCEL_ERRORS = ["#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!", "#ERROR!"]

# --- fixed values: extra missing-value tokens of delimited text -----------
CSV_NA_EXTRA = ["", "NA", "N/A", "NULL", "None"]
CSV_NA_TOKENS = EXCEL_ERRORS + CSV_NA_EXTRA

# --- fixed values: whitespace that is trimmed from cells (Unicode's White_Space, as in ``(?U)\\s``)
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# --- fixed values: characters removed before a number is parsed -----------
NUMBER_STRIP_PATTERN = r"[\$,£€¥₹%\s]"
CURRENCY_CHAR_PATTERN = r"[\$,£€¥₹]"
# strict shape of what is left; rejects Java suffixes (5d, 5f), nan, inf
NUMBER_SHAPE_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# characters removed by the header scorer's "pure number" test
HEADER_NUMBER_STRIP_PATTERN = r"[,\$€£%]"

# --- fixed values: footer / total rows ------------------------------------
TOTAL_ROW_PATTERN = (
    r"(?iU)^\s*(grand\s+)?(total|subtotal|summary|balance|net\s+total|amount\s+in\s+words"
    r"|page\s+\d+|report\s+generated|notes?|disclaimer|\*\*\*)\b"
)

# --- fixed values: semantic-type patterns ----------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE_PATTERN = r"(?U)^\+?[\d\s\-\(\)]{7,20}$"
URL_PATTERN = r"(?iU)^https?://[^\s/$.?#].[^\s]*$"
IMAGE_URL_PATTERN = r"(?iU)^https?://[^\s]+\.(jpg|jpeg|png|gif|webp|svg)(\?.*)?$"
FILE_URL_PATTERN = r"(?iU)^https?://[^\s]+\.(pdf|doc|docx|zip|rar|csv|xlsx|xls)(\?.*)?$"

# --- fixed values: column-name keywords ------------------------------------
ID_KEYWORDS = ["id", "uuid", "guid", "key", "code", "sk", "pk", "no", "number"]
NAME_TOKEN_SPLIT = r"[\s_\-]+"
CURRENCY_NAME_KEYWORDS = ["amount", "price", "cost", "bill", "salary", "fee",
                          "revenue", "income", "sales", "total"]
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "y", "n", "1", "0"]
HEADER_KEYWORDS = [
    "date", "time", "bill", "number", "no", "id", "amount", "price", "cost", "total",
    "category", "type", "name", "customer", "product", "qty", "quantity", "status",
    "description", "patient", "department", "segment", "region", "sales", "discount", "code",
]

# --- fixed values: thresholds and bounds -----------------------------------
TYPE_RATIO = 0.8            # share of non-null values a rule needs
SUBLABEL_RATIO = 0.2        # share with % or currency sign for the sub-label
CATEGORY_MAX_DISTINCT = 100
HEADER_SCAN_ROWS = 30
TOP_K_VALUES = 10
SCATTER_POINTS = 500
CHART_MEASURES = 4
BAR_TOP_N = 15
PIE_TOP_N = 10
BAR_HORIZONTAL_OVER = 6
OTHERS_LABEL = "Others"
MAX_INSIGHTS = 6
MAX_UPLOAD_BYTES = 50 * 1024 * 1024

# --- fixed values: known counter keys --------------------------------------
COUNTER_KEYS = ["total_visitors", "total_uploads", "total_analyses"]

# --- fixed values: accepted date / time layouts, tried in this order -------
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd[ HH:mm:ss]",
    "yyyyMMdd",
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "M.d.yyyy",
    "d.M.yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "MMMM d, yyyy",
    "yyyy-MM",
]

# --- fixed values: titles and descriptions of charts ({x}: date, category or first column; {y}: measure or second column)
CHART_TEXTS = {
    "line": ("{y} Trend over {x}", "Line trend of {y} over {x}."),
    "area": ("{y} Cumulative Trend ({x})", "Area chart showing {y} accumulation over time."),
    "bar": ("{y} by {x}", "Comparison of {y} across {x} categories."),
    "pie": ("{y} Distribution by {x}", "Pie chart breakdown of {y} across {x}."),
    "donut": ("{y} Share ({x})", "Donut chart showing proportional share of {y}."),
    "histogram": ("Histogram of {x}", "Binned frequency distribution for {x}."),
    "boxplot": ("Boxplot of {x}", "Five-number summary (Min, Q1, Median, Q3, Max) for {x}."),
    "frequency": ("{x} Frequency", "Distribution count across {x}."),
    "scatter": ("{x} vs {y}", "Relationship between {x} and {y}."),
    "heatmap": ("Correlation Heatmap", "Pearson correlation matrix across numeric fields."),
}

# --- fixed values: titles and descriptions of insights
INSIGHT_TEXTS = {
    "summary": ("Dataset health is {quality}", "Analyzed {rows} rows with {missing}% missing cells and {duplicates} duplicate rows."),
    "duplicates": ("Duplicate rows detected", "{duplicates} duplicate rows were found and should be reviewed."),
    "missing": ("Columns with substantial missing data", "{columns}"),
    "correlation": ("Strong {direction} relationship found", "{x} and {y} have a correlation of {r}."),
    "outliers": ("Outliers in {x}", "{n} values fall outside the 1.5x IQR boundary."),
    "dominant": ("Dominant category in {x}", "{value} accounts for {share}% of the column."),
}

# --- fixed values: warnings of an analysis
COLUMN_WARNING = "Column '{x}' could not be fully analyzed: {reason}"
