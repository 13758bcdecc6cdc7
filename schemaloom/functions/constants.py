"""Values that have to equal the published ones for results to agree."""

# --- fixed values -----------------------------------------------------------
# SQL keywords that may not be used as a synthetic name.
SQL_KEYWORDS = (
    "abort", "action", "add", "after", "all", "alter", "analyze", "and", "as", "asc", "attach", "autoincrement",
    "before", "begin", "between", "by", "cascade", "case", "cast", "check", "collate", "column", "commit", "conflict",
    "constraint", "create", "cross", "current_date", "current_time", "current_timestamp", "database", "default",
    "deferrable", "deferred", "delete", "desc", "detach", "distinct", "drop", "each", "else", "escape", "except",
    "exclusive", "exists", "explain", "fail", "for", "foreign", "from", "full", "glob", "group", "having", "if",
    "ignore", "immediate", "in", "index", "indexed", "initially", "inner", "insert", "instead", "intersect", "into",
    "is", "isnull", "join", "key", "left", "like", "limit", "match", "natural", "no", "not", "notnull", "null", "of",
    "offset", "on", "or", "order", "outer", "plan", "pragma", "primary", "query", "raise", "recursive", "references",
    "regexp", "reindex", "release", "rename", "replace", "restrict", "right", "rollback", "row", "savepoint",
    "select", "set", "table", "temp", "temporary", "then", "to", "transaction", "trigger", "union", "unique",
    "update", "using", "vacuum", "values", "view", "virtual", "when", "where", "with", "without",
)

# Declared types with an exact type group; everything else is TEXT.
EXACT_TYPE_GROUPS = {
    "INT": "INTEGER",
    "INTEGER": "INTEGER",
    "TEXT": "TEXT",
    "REAL": "REAL",
    "FLOAT": "REAL",
    "DOUBLE": "REAL",
    "DATE": "TEXT",
    "TIMESTAMP": "TEXT",
}

# Substring rules, first match wins; a missing type is BLOB and no match is NUMERIC.
AFFINITY_RULES = (
    (("INT",), "INTEGER"),
    (("CHAR", "CLOB", "TEXT"), "TEXT"),
    (("BLOB",), "BLOB"),
    (("REAL", "FLOA", "DOUB"), "REAL"),
    (("DATE", "TIME"), "DATE"),
)

# Senses whose words never become table names.
EXCLUDED_LEXNAMES = ("noun.person", "noun.location", "noun.group")

# Attribute templates of synthetic entity and metadata tables, in order.
ENTITY_ATTRIBUTES = (
    ("name", "TEXT"),
    ("description", "TEXT"),
    ("content", "TEXT"),
    ("type", "TEXT"),
    ("status", "TEXT"),
    ("created_at", "TIMESTAMP"),
    ("updated_at", "TIMESTAMP"),
    ("count", "INT"),
    ("year", "INT"),
)
META_ATTRIBUTES = (
    ("key", "TEXT"),
    ("value", "TEXT"),
    ("timestamp", "TIMESTAMP"),
    ("flag", "INT"),
    ("status", "TEXT"),
)
META_SUFFIXES = ("_log", "_entry", "_state", "_snapshot")

# Shares of new tables by kind (metadata tables take the rest), least and most columns of a kind,
# chances of an event for one table, and the part of an original table's columns that a family takes.
TABLE_SHARES = {"entity": 0.60, "join": 0.25}
TABLE_WIDTHS = {"entity": (6, 12), "meta": (5, 8)}
TABLE_CHANCES = {"family": 0.4, "meta-fk": 0.10}
FAMILY_PART = 0.6

# Word separators: whitespace as Unicode text splitting understands it, and the underscore.
SEPARATORS = (
    r"[_\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# ---------------------------------------------------------------------------

DEFAULT_INSTRUCTION = (
    "Answer the question with one SQLite SELECT statement over the schema below. "
    "Use only tables and columns the schema defines and return the statement "
    "through the `sql` argument of the tool."
)
