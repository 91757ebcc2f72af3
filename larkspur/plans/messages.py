"""Texts of the errors that a client sees."""

# Fixed values.

# Any statement
EMPTY = "empty SQL"
UNSUPPORTED = "unsupported SQL statement"
TRAILING = "unexpected tokens at end of query"
OPEN_STRING = "unterminated string literal"
NUMBER = "invalid numeric literal"
VALUE = "expected value"

# CREATE and DROP
TABLE = "expected TABLE"
TABLE_NAME = "expected table name"
OPEN = "expected '('"
CLOSE_COLUMNS = "expected ')' at end of column list"
COLUMN_NAME = "expected column name"
TYPE = "expected DECIMAL, INT, DATETIME, FLOAT, REAL, TEXT or VARCHAR"
OPEN_VARCHAR = "expected '(' after VARCHAR"
VARCHAR_LENGTH = "expected VARCHAR length"
BAD_LENGTH = "invalid VARCHAR length"
CLOSE = "expected ')'"
KEY = "expected KEY after PRIMARY"
NULL = "expected NULL after NOT"
EXISTS = "expected EXISTS after IF"

# INSERT and BULK_INSERT
INTO = "expected INTO"
VALUES = "expected VALUES"
OPEN_VALUES = "expected '(' in VALUES"
CLOSE_VALUES = "expected ')' in VALUES"
BULK = "invalid BULK_INSERT arguments"
BULK_SIZE = "BULK_INSERT size too large"
BULK_TRAILING = "unexpected trailing characters"

# SELECT
IDENTIFIER = "expected column identifier"
AFTER_DOT = "expected column name after '.'"
OPEN_COUNT = "expected '(' after COUNT"
STAR_COUNT = "expected '*' in COUNT(*)"
CLOSE_COUNT = "expected ')' after COUNT(*"
ALIAS = "expected alias after AS"
FROM = "expected FROM"
FROM_TABLE = "expected table name after FROM"
JOIN = "expected JOIN"
JOIN_TABLE = "expected join table"
ON = "expected ON"
JOIN_EQUALS = "expected '=' in join condition"
OPERATOR = "expected WHERE operator (=, <, >, <=, >=)"

# Running a statement
NO_TABLE = "no such table: {}"
TABLE_EXISTS = "table already exists"
DUPLICATE_COLUMN = "duplicate column name"
COLUMN_COUNT = "column count mismatch"
NEEDS_INTEGER = "type mismatch: expected integer value"
NEEDS_NUMBER = "type mismatch: expected numeric value"
NEEDS_TEXT = "type mismatch: expected VARCHAR"
DUPLICATE_KEY = "duplicate primary key"
BIG_USERS_SCHEMA = "BIG_USERS schema mismatch"
READ_ONLY = "table is read-only: {}"
COUNT_JOIN = "COUNT(*) with JOIN is not supported"
JOIN_COLUMN = "unknown join column"
COLUMN = "unknown column: {}"
WHERE_COLUMN = "unknown column in WHERE: {}"
