"""Column functions over SQL text: tables, columns, identifiers, generated column references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import text as tx

# Patterns of SQL and generated mapper text, and words that are no columns or tables.
SQL_WORDS = (
    "select", "from", "where", "join", "on", "insert", "into", "values", "update", "set", "delete", "and", "or", "as",
    "null", "true", "false", "asc", "desc",
)
GENERATED_IGNORE = (
    "select", "from", "where", "and", "or", "as", "distinct", "count", "sum", "min", "max", "avg", "case", "when", "then",
    "else", "end", "null", "current_timestamp", "current_date", "current_time", "true", "false", "now", "values", "set",
    "update", "insert", "into", "delete", "order", "by", "group", "having", "limit", "offset", "desc", "asc", "on", "join",
    "left", "right", "inner", "outer",
)
TABLE_FIELDS = ("table_name", "tablename", "table", "name")
IGNORED_TABLE_TOKENS = ("table", "tables", "schema", "database", "public", "name", "type", "comment", "comments", "tb", "tbl", "t", "m")
TABLE_KEYS = ("table_name", "tableName", "tablename", "table", "name")
COLUMN_KEYS = ("column_name", "columnName", "column", "field", "name")
COLUMN_FIELDS = ("column_name", "columnname", "column", "field", "name")
IGNORED_COLUMN_TOKENS = (
    "column", "column_name", "columnname", "name", "type", "data_type", "datatype", "nullable", "null", "default", "comment",
    "comments", "key", "pk", "primary", "not", "constraint", "constraints", "ordinal_position", "position", "no", "none",
    "result", "results",
)
TABLE_PATTERN = "^[A-Za-z][A-Za-z0-9_]*(\\.[A-Za-z][A-Za-z0-9_]*)?$"
COLUMN_PATTERN = "^[A-Za-z_][A-Za-z0-9_]*$"
QUALIFIED_TABLE = "[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)?"
COLUMN_ATTRIBUTE = "(?i)\\bcolumn\\s*=\\s*[\"']([A-Za-z_][A-Za-z0-9_]*)[\"']"
SQL_FRAGMENT = "(?is)<sql\\b[^>]*>(.*?)</sql>"
INSERT_LIST = f"(?is)\\binsert\\s+into\\s+{QUALIFIED_TABLE}\\s*\\((.*?)\\)"
UPDATE_SET = f"(?is)\\bupdate\\s+{QUALIFIED_TABLE}\\s+set\\s+(.*?)(?:\\bwhere\\b|</update>|$)"
SELECT_LIST = f"(?is)\\bselect\\s+(.*?)\\s+from\\s+{QUALIFIED_TABLE}"
MAPPER_TABLE = "(?i)\\b(?:from|join|into|update)\\s+([A-Za-z0-9_.$]+)"
PARAMETER = "[#][$]?[{][^}]+[}]"
LABELED_TABLE = "(?i)(?:table[_\\s-]?name|table|name)\\s*[:=]\\s*[`\"]?([A-Za-z][A-Za-z0-9_]*(?:\\.[A-Za-z][A-Za-z0-9_]*)?)"


def normalize(sql: Column) -> Column:
    return tx.strip(F.regexp_replace(sql, "\\s+", " "))


def clean_identifier(token: Column) -> Column:
    return F.regexp_replace(token, "[^\\p{L}\\p{N}_.]", "")


def statement_tables(sql: Column, operation: Column) -> Column:
    """Qualified tables a statement reads (FROM, JOIN) or writes (INTO, UPDATE, DELETE FROM)."""
    flat = F.translate(sql, ",()", "   ")
    read = F.regexp_extract_all(flat, F.lit("(?i)(?:^|\\s)(?:from|join)\\s+(\\S+)"), F.lit(1))
    write = F.regexp_extract_all(flat, F.lit("(?i)(?:^|\\s)(?:into|update|delete\\s+from)\\s+(\\S+)"), F.lit(1))
    found = F.transform(F.when(operation == "READ", read).otherwise(write), clean_identifier)
    return F.array_distinct(F.filter(found, lambda t: F.substring_index(t, ".", -1) != ""))


def mapper_tables(sql: Column) -> Column:
    """Tables of a mapper statement, whatever it does with them."""
    found = F.regexp_extract_all(sql, F.lit(MAPPER_TABLE), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: tx.strip(F.replace(t, F.lit("$"), F.lit("")))), lambda t: t != ""))


def schema_of(qualified: Column) -> Column:
    return F.when(F.contains(qualified, F.lit(".")), F.regexp_extract(qualified, "^(.*)\\.[^.]*$", 1)).otherwise("public")


def table_of(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def statement_columns(sql: Column, operation: Column) -> Column:
    """Columns of the select list, the insert list or the set list; none for a star."""
    upper = F.upper(sql)
    expression = (
        F.when(operation == "READ", F.regexp_extract(sql, "(?is)select(.*?)from", 1))
        .when(upper.startswith("INSERT"), F.regexp_extract(sql, "(?s)\\(([^)]*)\\)", 1))
        .when(upper.startswith("UPDATE"), F.regexp_extract(sql, "(?is)\\sset\\s(.*?)(?:\\swhere\\s.*)?$", 1))
        .otherwise(""))
    items = F.when(F.contains(expression, F.lit("*")), F.array().cast("array<string>")).otherwise(F.split(expression, ","))

    def column(item):
        head = F.regexp_replace(F.regexp_replace(tx.strip(item), "(?is)\\sas\\s.*$", ""), "(?s)=.*$", "")
        return table_of(clean_identifier(F.regexp_extract(head, "(\\S+)", 1)))

    return F.array_distinct(F.filter(F.transform(items, column), lambda c: c != ""))


def mapper_columns(sql: Column, tables: Column) -> Column:
    """Identifiers of a mapper statement that are neither SQL words nor parts of its table names."""
    plain = F.regexp_replace(sql, PARAMETER, " ")
    parts = F.flatten(F.transform(tables, lambda t: F.split(F.lower(t), "\\.")))
    words = F.regexp_extract_all(plain, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(*SQL_WORDS) & ~F.array_contains(parts, F.lower(w))))


def _generated(candidate: Column) -> Column:
    """Column name of one listed expression, empty when it is none."""
    item = tx.strip(candidate)
    rejected = item.startswith("<") | item.rlike("[#$]\\{|\\(")
    plain = F.regexp_replace(item, "(?i)\\s+as\\s+[A-Za-z_][A-Za-z0-9_]*", "")
    token = F.translate(F.regexp_extract(plain, "(\\S+)", 1), "`\"'[]", "")
    token = F.regexp_replace(F.regexp_replace(token, "^[^A-Za-z_]+", ""), "[^A-Za-z0-9_]+$", "")
    token = table_of(token)
    ok = ~rejected & token.rlike(COLUMN_PATTERN) & ~F.lower(token).isin(*GENERATED_IGNORE)
    return F.when(ok, token).otherwise("")


def generated_columns(code: Column) -> Column:
    """Columns a generated mapper refers to, from five kinds of places, first mention first."""
    def listed(pattern):
        return F.flatten(F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), lambda s: F.split(s, "[,\\r\\n]+")))

    attributes = F.regexp_extract_all(code, F.lit(COLUMN_ATTRIBUTE), F.lit(1))
    fragments = listed(SQL_FRAGMENT)
    inserts = listed(INSERT_LIST)
    sets = F.flatten(F.transform(
        F.regexp_extract_all(code, F.lit(UPDATE_SET), F.lit(1)),
        lambda s: F.transform(F.filter(F.split(s, ","), lambda a: F.instr(a, "=") > 1), lambda a: F.substring_index(a, "=", 1))))
    selects = listed(SELECT_LIST)
    every = F.concat(attributes, fragments, inserts, sets, selects)
    return F.array_distinct(F.filter(F.transform(every, _generated), lambda c: c != ""))


def clean_table(candidate: Column) -> Column:
    plain = F.translate(tx.strip(candidate), "`\"'[]()", "")
    return tx.strip(F.regexp_replace(F.regexp_replace(plain, "^[-*\\s]+", ""), "[,:;]+$", ""))


def clean_column(candidate: Column) -> Column:
    plain = F.regexp_replace(F.translate(tx.strip(candidate), "`\"'[]()", ""), "^[-*\\s]+", "")
    head = F.when(F.instr(plain, ":") > 1, F.substring_index(plain, ":", 1)).otherwise(plain)
    token = F.regexp_replace(F.regexp_extract(head, "(\\S+)", 1), "[,:;]+$", "")
    return tx.strip(table_of(token))


def table_names(text: Column, in_json: Column) -> Column:
    """All table names in a tool's reply: those in its JSON, ``table: x`` labels, piped cells, whole lines and their heads."""
    lines = F.filter(F.transform(F.split(text, "\\R"), lambda s: tx.strip(s)), lambda s: s != "")
    from_lines = F.flatten(F.transform(lines, lambda s: F.when(F.contains(s, F.lit("|")), F.split(s, "\\|")).otherwise(
        F.array(s, F.when(F.instr(s, ":") > 1, F.substring_index(s, ":", 1)).otherwise(""),
                F.when(F.instr(s, " - ") > 1, F.substring_index(s, " - ", 1)).otherwise("")))))
    every = F.concat(in_json, F.regexp_extract_all(text, F.lit(LABELED_TABLE), F.lit(1)), from_lines)
    return F.array_distinct(F.filter(
        F.transform(every, clean_table),
        lambda t: t.rlike(TABLE_PATTERN) & ~F.lower(t).isin(*TABLE_FIELDS) & ~F.lower(t).isin(*IGNORED_TABLE_TOKENS)))


def column_names(text: Column, in_json: Column) -> Column:
    """Column names in a tool's reply: those in its JSON, first cells of piped lines and whole lines."""
    lines = F.filter(F.transform(F.split(text, "\\R"), lambda s: tx.strip(s)), lambda s: s != "")
    heads = F.transform(lines, lambda s: F.substring_index(s, "|", 1))
    every = F.concat(in_json, heads)
    return F.array_distinct(F.filter(
        F.transform(every, clean_column),
        lambda c: c.rlike(COLUMN_PATTERN) & ~F.lower(c).isin(*COLUMN_FIELDS) & ~F.lower(c).isin(*IGNORED_COLUMN_TOKENS)))
