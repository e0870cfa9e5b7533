"""Column functions over method bodies: normal forms, hashes, counters and complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import strip

# Pieces of Java text. A literal left open runs to the end of the text.
TEXT_BLOCK = r'"""(?:[\s\S]*?)(?:"""|\z)'
STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\z)'
CHARACTER = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\z)"
LITERAL = f"{TEXT_BLOCK}|{STRING}|{CHARACTER}"
COMMENT = r"//[^\r\n]*+|/\*[\s\S]*?(?:\*/|\z)"
NUMBER = r"(?<![\w$])(?:0[xX][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]+)?(?:[eE][+-]?[0-9]+)?)[lLfFdD]?"
MEMBER = r"\.\s*[A-Za-z_$][\w$]*+"
CALLED = r"(?<![\w$])[A-Za-z_$][\w$]*+(?=\s*\()"
IDENTIFIER = r"(?<![\w$])[A-Za-z_$][\w$]*+"
DO_WHILE_TAIL = r"\}\s*while\s*\([^;{}]*\)\s*;"
TERNARY = r"\?(?![?>,]|\s*(?:extends|super)\b)"
NOT_CALLS = "if|for|while|switch|catch|return|throw|synchronized|super|this|do|else|try|assert|case"
DECLARATION = (
    r"(?<![\w$.])(?:int|long|double|float|boolean|char|byte|short|var|[A-Z][\w.]*(?:<[^;=(){}]*>)?)(?:\[\])*\s+"
    r"([a-z_$][\w$]*)\s*(?=[=;:,)])"
)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for an expression that uses it in many places or inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def without_comments(body: Column) -> Column:
    """Body without comments; comment marks inside literals stay."""
    pieces = _pieces(body, f"{LITERAL}|{COMMENT}|[^\"'/]+|[\"'/]")
    return F.array_join(F.filter(pieces, lambda p: ~(p.startswith("//") | p.startswith("/*"))), "")


def compact(body: Column) -> Column:
    """Whitespace removed everywhere except inside literals."""
    pieces = _pieces(body, f"{LITERAL}|[^\"']+")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"') | p.startswith("'"), p).otherwise(
        F.regexp_replace(p, r"\s+", ""))), "")


def method_hash(body: Column) -> Column:
    return F.sha2(compact(without_comments(body)), 256)


def local_names(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(masked(body), F.lit(DECLARATION), F.lit(1)))


def structural(body: Column, names: Column) -> Column:
    """Normal form where every literal and every use of a known variable look the same."""
    pieces = _pieces(without_comments(body), f"{LITERAL}|{MEMBER}|{CALLED}|{NUMBER}|{IDENTIFIER}|[\\s\\S]")

    def replaced(p, known):
        literal = p.rlike("^[\"']") | p.rlike("^[0-9]") | p.isin("true", "false", "null")
        return (F.when(literal, F.lit("$literal")).when(F.array_contains(known, p), F.lit("$variable"))
                .otherwise(F.regexp_replace(p, r"\s+", "")))

    return let(names, lambda known: F.array_join(F.transform(pieces, lambda p: replaced(p, known)), ""))


def structural_hash(body: Column, parameters: Column) -> Column:
    return F.sha2(structural(body, F.array_union(parameters, local_names(body))), 256)


def masked(body: Column) -> Column:
    """Comments dropped and literals emptied, so that words inside them count for nothing."""
    return F.regexp_replace(without_comments(body), LITERAL, '""')


def counters(body: Column) -> Column:
    """Struct of logical operators, returns, throws, calls and lines."""
    m = masked(body)

    def n(pattern):
        return F.regexp_count(m, F.lit(pattern)).cast("long")

    calls = rf"(?<![\w$])(?!(?:{NOT_CALLS})\b)(?<!\bnew\s{{1,4}})[A-Za-z_$][\w$]*+\s*\("
    return F.struct(
        n(r"&&|\|\|").alias("logical"), n(r"\breturn\b").alias("returns"), n(r"\bthrow\b").alias("throws"),
        n(calls).alias("calls"), (F.regexp_count(body, F.lit("\n")) + 1).cast("long").alias("lines"))


def complexity(body: Column) -> Column:
    """Struct of branches, cyclomatic, cognitive and deepest nesting.

    One fold over the control tokens. ``open`` holds, per open brace, how many nesting levels it adds
    (0 for a plain block); ``pending`` is the level of a branch whose body has not begun, so a body
    without braces nests what follows up to its semicolon; ``closed`` remembers the level of the block
    an ``else`` continues.
    """
    m = F.regexp_replace(masked(body), DO_WHILE_TAIL, "};")
    tokens = F.regexp_extract_all(
        m, F.lit(rf"(\b(?:if|for|while|do|catch|switch|case|default(?=\s*(?::|->))|else)\b|&&|\|\||{TERNARY}|[{{}}();])"), F.lit(1))
    start = F.struct(
        F.array().cast("array<int>").alias("open"), F.lit(0).alias("pending"), F.lit(0).alias("closed"), F.lit(0).alias("parens"),
        F.lit(0).alias("branches"), F.lit(0).alias("logical"), F.lit(0).alias("depths"), F.lit(0).alias("deepest"))

    def step(a, t):
        levels = F.aggregate(a["open"], F.lit(0), lambda s, v: s + v)
        top = F.coalesce(F.element_at(F.when(F.size(a["open"]) > 0, a["open"]), -1), F.lit(0))
        entry = t.isin("case", "default")
        branch = t.isin("if", "for", "while", "do", "catch") | entry | (t == "?")
        depth = F.when(entry, levels - top + 2).otherwise(levels + a["pending"] + 1)
        inner_paren = a["parens"] > 0
        opened = F.when(t == "{", F.array_append(a["open"], a["pending"])) \
            .when(t == "}", F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(0)))) \
            .when(entry, F.array_append(F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(0))), F.lit(2))) \
            .otherwise(a["open"])
        pending = F.when(t.isin("{", "}"), 0).when((t == ";") & ~inner_paren, 0).when(t == "else", a["closed"]) \
            .when(t.isin("if", "for", "while", "do", "catch", "switch"), a["pending"] + 1).otherwise(a["pending"])
        # The level an else goes on from: the block just closed, or the statement just ended.
        closed = F.when(t == "}", top).when((t == ";") & ~inner_paren & (a["pending"] > 0), a["pending"]).otherwise(a["closed"])
        return F.struct(
            opened.alias("open"), pending.cast("int").alias("pending"), closed.cast("int").alias("closed"),
            (a["parens"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("parens"),
            (a["branches"] + F.when(branch, 1).otherwise(0)).alias("branches"),
            (a["logical"] + F.when(t.isin("&&", "||"), 1).otherwise(0)).alias("logical"),
            (a["depths"] + F.when(branch, depth).otherwise(0)).alias("depths"),
            F.greatest(a["deepest"], F.when(branch, depth).otherwise(0)).alias("deepest"))

    return F.aggregate(tokens, start, step, lambda a: F.struct(
        a["branches"].cast("long").alias("branches"), (a["branches"] + a["logical"] + 1).cast("long").alias("cyclomatic"),
        (a["depths"] + a["logical"]).cast("long").alias("cognitive"), a["deepest"].cast("long").alias("nesting")))


def layer(simple_name: Column, annotations: Column) -> Column:
    """Architecture layer by name suffix or annotation; the first rule that fits wins."""
    name = F.lower(simple_name)
    tags = F.transform(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: F.lower(a))
    has = lambda *xs: F.exists(tags, lambda t: t.isin(*xs))
    return (
        F.when(name.endswith("controller") | has("restcontroller", "controller"), "Controller")
        .when(name.endswith("serviceimpl"), "ServiceImpl")
        .when(name.endswith("service") | has("service"), "Service")
        .when(name.endswith("repository") | has("repository"), "Repository")
        .when(name.endswith("mapper") | has("mapper"), "Mapper")
        .when(name.rlike("(dto|request|response)$"), "DTO")
        .when(name.endswith("exception"), "Exception").when(name.endswith("test"), "Test Code").otherwise("Domain"))


# Types that never become graph nodes, and package prefixes that are skipped.
COMMON_TYPES = (
    "String", "Boolean", "Byte", "Short", "Integer", "Long", "Float", "Double", "Character", "Object", "List", "Set",
    "Map", "Collection", "Optional", "Page", "Pageable", "ResponseEntity", "LocalDate", "LocalDateTime", "BigDecimal",
    "BigInteger", "Void",
)


def skipped_fqn(fqn: Column) -> Column:
    """Names that are no type of the project: blank ones, those of the platform, imports of a whole package."""
    return F.coalesce(F.trim(fqn) == "", F.lit(True)) | F.coalesce(fqn.endswith(".*"), F.lit(True)) | F.coalesce(fqn.rlike(r"^(java|javax|jakarta)\."), F.lit(True))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def signature(name: Column, parameter_types: Column) -> Column:
    plain = F.transform(parameter_types, lambda p: F.regexp_replace(p, r"\s+", ""))
    return F.concat(name, F.lit("("), F.array_join(plain, ","), F.lit(")"))


# Request mapping annotations and their verbs.
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH",
         "DeleteMapping": "DELETE", "RequestMapping": "REQUEST"}


def http_verb(annotation_name: Column, annotation_text: Column) -> Column:
    verb = F.lit(None).cast("string")
    for name, value in VERBS.items():
        verb = F.when(annotation_name == name, value).otherwise(verb)
    named = F.nullif(F.regexp_extract(annotation_text, r"RequestMethod\.([A-Z]+)", 1), F.lit(""))
    return F.when(verb == "REQUEST", F.coalesce(named, F.lit("REQUEST"))).otherwise(verb)


def first_quoted(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), '"([^"]*)"', 1)


def endpoint_path(class_path: Column, method_path: Column) -> Column:
    joined = F.regexp_replace(F.concat(F.lit("/"), F.trim(class_path), F.lit("/"), F.trim(method_path)), "/+", "/")
    return F.when((F.length(joined) > 1) & joined.endswith("/"), F.rtrim(F.regexp_replace(joined, "/$", ""))).otherwise(joined)


# Fence of a generated code block and the words a Java text begins with.
CODE_BLOCK = "(?i)```(?:java)?\\s*([\\s\\S]*?)```"
JAVA_START = ("package ", "import ", "@", "public ", "class ", "interface ", "enum ", "record ")


def trim_to_java(text: Column) -> Column:
    """From the first Java keyword on, or the whole stripped text when there is none."""
    def cut_at_start(plain):
        starts = F.filter(F.array(*[F.instr(plain, k) for k in JAVA_START]), lambda i: i > 0)
        return let(F.array_min(starts), lambda i: F.when(i.isNull(), plain).otherwise(F.substring(plain, i, F.length(plain))))

    return let(strip(text), cut_at_start)


def code_blocks(text: Column) -> Column:
    """Java candidates of a generated answer: its fenced blocks, or all of it when it has none."""
    fenced = F.filter(F.transform(F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(1)), trim_to_java),
                      lambda b: F.trim(b) != "")
    return let(fenced, lambda blocks: F.when(F.size(blocks) > 0, blocks).otherwise(F.array(trim_to_java(text))))
