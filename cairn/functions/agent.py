"""Column functions over user messages: intent, named arguments, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.code import let
from cairn.functions.text import contains_any, non_blank, strip

# Phrases of each intent, in the order the intents are tried.
RULE_LIST = ("rule list", "rules list", "규칙 목록", "룰 목록")
TABLE_LIST = ("database tables", "database table list", "table list", "tables list", "테이블 목록", "전체 테이블", "테이블과 뷰", "테이블 및 뷰")
JAVA_SOURCE = (
    "java", "source code", "source", "controller", "repository", "mapper", "dto", "class", "method", "package", "annotation",
    "call graph", "dependency", "impact analysis", "serviceimpl", "자바", "소스", "코드", "컨트롤러", "리포지토리", "레포지토리", "매퍼",
    "클래스", "메서드", "메소드", "패키지", "어노테이션", "호출 관계", "호출관계", "의존 관계", "의존관계", "영향도", "구현체",
)
PROJECT_STRUCTURE = ("project structure", "project analysis", "analyze project", "spring boot", "springboot", "프로젝트", "구조", "분석")
WINDOWS_PATH = "(?i)([a-z]:\\\\[^\\s\"'<>|]+)"
# Possessive groups are matched in a loop, others call themselves; nothing begins inside a run it has been through.
FILE_PATH = "(?i)((?:(?=[A-Za-z]:\\\\)|(?<![A-Za-z0-9_.-]))(?:[A-Za-z]:\\\\|/)?[A-Za-z0-9_.-]++(?:[\\\\/][A-Za-z0-9_.-]++)++)"
FILE_NAME = "(?i)((?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]+\\.(?:java|sql|xml|pdf|png|jpe?g|bmp|gif|tiff?|webp))"
TABLE_REFERENCE = "(?i)([A-Za-z][A-Za-z0-9_]*(?:\\.[A-Za-z][A-Za-z0-9_]*)?)\\s*(?:테이블|table\\b)"
QUOTED = "\"([^\"]+)\"|'([^']+)'"
CODE_FENCE = "(?s)```(?:java|sql|xml)?\\s*(.*?)```"
JAVA_REFERENCE = "(?<![A-Za-z0-9_$])([A-Za-z_$][A-Za-z0-9_$]*+(?:\\.[A-Za-z_$][A-Za-z0-9_$]*+)*+)"
JAVA_SUFFIXES = (
    "Controller", "ServiceImpl", "Service", "Repository", "Mapper", "Dto", "DTO", "Entity", "Domain", "Configuration", "Config",
    "Exception", "Client", "Gateway", "Adapter",
)
JAVA_STOP_WORDS = (
    "api", "class", "code", "dependency", "dto", "field", "java", "mapper", "mcp", "method", "package", "repository", "service",
    "source", "sql", "tool",
)


def windows_path(message: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(message, WINDOWS_PATH, 1), "[.,;:]+$", "")


def intent(message: Column) -> Column:
    """Intent of a message: the first rule whose phrase it contains."""
    def classify(m):
        has = lambda *phrases: contains_any(m, phrases)
        return (
            F.when(has(*RULE_LIST), "RULE_LIST").when(has(*TABLE_LIST), "TABLE_LIST").when(has(*JAVA_SOURCE), "SOURCE_SEARCH")
            .when(m.rlike(WINDOWS_PATH) & has(*PROJECT_STRUCTURE), "PROJECT_STRUCTURE_ANALYSIS")
            .when(has("server://info", "resource read", "read resource"), "RESOURCE_READ").when(has("resources", "resource"), "RESOURCE_LIST")
            .when(has("summarize_server_status"), "PROMPT_GET").when(has("prompts", "prompt"), "PROMPT_LIST").when(has("server info"), "SERVER_INFO_TOOL")
            .when(has("tools", "tool"), "TOOL_LIST").when(has("ping", "status", "health"), "PING").otherwise("SERVER_INFO"))

    return let(F.lower(F.coalesce(message, F.lit(""))), classify)


def explicit_argument(message: Column, *names: str) -> Column:
    """Value of ``name: value``, ``name="value"`` or ``name='value'``; empty when absent."""
    alternatives = "|".join(names)
    pattern = f"(?is)(?:^|[\\s,{{(])(?:{alternatives})\\s*[:=]\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s,}})]+))"
    groups = [non_blank(F.regexp_extract(message, pattern, g)) for g in (1, 2, 3)]
    return F.coalesce(*groups, F.lit(""))


def table_argument(message: Column) -> Column:
    named = F.filter(F.regexp_extract_all(message, F.lit(TABLE_REFERENCE), F.lit(1)), lambda t: ~F.lower(t).isin("all", "database"))
    return F.coalesce(non_blank(explicit_argument(message, "tableName", "table_name", "table")), F.get(named, 0), F.lit(""))


def path_argument(message: Column, *names: str) -> Column:
    found = F.regexp_replace(F.regexp_extract(message, FILE_PATH, 1), "[.,;:]+$", "")
    return F.coalesce(non_blank(explicit_argument(message, *names)), non_blank(windows_path(message)), found)


def file_argument(message: Column) -> Column:
    return F.coalesce(non_blank(explicit_argument(message, "file_name", "fileName")), F.regexp_extract(message, FILE_NAME, 1))


def quoted_text(message: Column) -> Column:
    return F.coalesce(non_blank(F.regexp_extract(message, QUOTED, 1)), F.regexp_extract(message, QUOTED, 2))


def fenced_code(message: Column) -> Column:
    return strip(F.regexp_extract(message, CODE_FENCE, 1))


def java_score(name: Column) -> Column:
    simple = F.substring_index(name, ".", -1)
    return (
        F.when(F.contains(name, F.lit(".")), 300).otherwise(0) + F.when(simple.rlike("(" + "|".join(JAVA_SUFFIXES) + ")$"), 200).otherwise(0)
        + F.when(simple.rlike("^\\p{Lu}"), 100).otherwise(0) + F.when(simple.rlike("^.+\\p{Lu}"), 50).otherwise(0))


def java_reference(message: Column) -> Column:
    """Best Java name in a text; of equally good ones the last."""
    names = F.transform(F.regexp_extract_all(message, F.lit(JAVA_REFERENCE), F.lit(1)), lambda n: F.regexp_replace(n, "\\.java$", ""))
    kept = F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(*JAVA_STOP_WORDS))
    ranked = F.transform(kept, lambda n, i: F.struct(java_score(n).alias("score"), i.alias("at"), n.alias("name")))
    return F.coalesce(F.array_max(ranked)["name"], F.lit(""))
