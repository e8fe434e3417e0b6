"""Results are only right when these equal the published behaviour.

Nothing here is a design choice of this library; change none of them.
"""

# Share of non-empty values that must match before a column gets a type.
TYPE_MATCH_SHARE = 0.95

BOOLEAN_TRUE = ("true", "yes", "t", "y")
BOOLEAN_FALSE = ("false", "no", "f", "n")

# Characters stripped around numbers.
NUMBER_PREFIX_CHARS = " $€£¥₹"
NUMBER_SUFFIX_CHARS = "% "

COLUMN_TYPES = ("BOOLEAN", "INTEGER", "DOUBLE", "DATE", "TIMESTAMP", "VARCHAR")

# White space as Unicode defines it (what a trim removes).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Row chunks and prompts.
PAIR_SEPARATOR = " | "
HEADER_SEPARATOR = ": "
QUESTION_SAMPLE_ROWS = 20
SUMMARY_SAMPLE_ROWS = 30
SQL_SAMPLE_ROWS = 5
ANSWER_CONTEXT_ROWS = 5
RAW_ANSWER_ROWS = 3

# Chunk ids are name-based UUIDs (version 5) in the DNS namespace of RFC 4122.
UUID_DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"

# Sparse vectors: FNV-1a, 32 bit, folded into 2^20 buckets.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
SPARSE_BUCKETS = 1 << 20
MIN_TERM_BYTES = 2

# Retrieval.
EMBED_BATCH = 96
MODEL_CALLS_AT_ONCE = 4
DEFAULT_TOP_K = 10
FETCH_FACTOR = 5
BRANCH_FACTOR = 2
HITS_PER_TABLE = 3
RRF_K = 2

# Answers.
NO_HITS_ANSWER = "No relevant data found."
IRRELEVANT_REPLY = "skip"
NO_ROWS_TEXT = "(no results)"
NULL_TEXT = "<nil>"
TABLE_NAME = "data"

# Substrings that make a statement unacceptable; the first in this order is reported.
DISALLOWED_SQL = (
    "drop ", "delete ", "insert ", "update ", "create ", "alter ",
    "truncate ", "replace ", "merge ", "upsert ",
    "copy ", "attach ", "detach ", "pragma ", "load ", "install ",
    "export ", "import ",
    "read_csv", "read_json", "read_ndjson", "read_parquet",
    "httpfs", "s3://", "http://", "https://",
    "/*", "*/",
)

# Labels of the prompts, in the order in which each prompt shows them.
TABLE_LABEL = "Table: "
TOTAL_ROWS_LABEL = "\nTotal rows: "
COLUMNS_LABEL = "\nColumns: "
ORIGINAL_COLUMNS_LABEL = "\nColumns (original names): "
SAMPLE_LABEL = "\n\nSample data:\n"
SCHEMA_LABEL = "Table name: data\nSchema:\n"
COLUMN_BULLET = "  - "
ORIGINAL_NAME_OPEN = '  [original: "'
ORIGINAL_NAME_CLOSE = '"]  ('
SAMPLE_ROWS_LABEL = "\nSample data rows:\n"
DESCRIPTIONS_LABEL = "Table descriptions:\n"
DESCRIPTION_LABEL = "Table description:\n"
QUESTION_LABEL = "Question: "
CONTEXT_LABEL = "\n\nContext (table rows):\n"
STATEMENT_LABEL = "\n\nSQL query executed:\n"
RESULTS_LABEL = "\n\nResults:\n"
