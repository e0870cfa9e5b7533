"""Source facts as tables: resolution of names and calls, structure and type edges, lineage, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions import code, ids, sqltext
from cairn.functions import text as tx
from cairn.operators import mentions
from cairn.session import cut

# Fixed values of the extractors.
CODE_CONFIDENCE, TEXT_CONFIDENCE = 1.0, 0.9
MATCH_LIMIT = 3
TOKEN_MIN = 3
BULLET = "^(?:[-*]|[0-9]+[.)])\\s+(?=.)"


def structure_edges(types: DataFrame) -> DataFrame:
    """Project, module, package and file containment and the declared types, from one pass over the types."""
    c = F.col
    project = F.concat_ws(":", F.lit("project"), "project_id")
    module = F.concat_ws(":", F.lit("module"), "project_id", "module_name")
    package = F.concat_ws(":", F.lit("package"), "project_id", F.coalesce(tx.non_blank(c("package_name")), F.lit("(default)")))
    file = ids.file_uid(c("project_id"), c("file_path"))
    links = F.array(*[F.struct(s.alias("src"), d.alias("dst"), F.lit(t).alias("type")) for s, d, t in (
        (project, module, "CONTAINS"), (module, package, "CONTAINS"), (package, file, "CONTAINS"), (file, c("type_uid"), "DECLARES"))])
    return types.select(F.explode(links).alias("e")).select("e.*").distinct()


def member_edges(methods: DataFrame, fields: DataFrame) -> DataFrame:
    return methods.select(F.col("type_uid").alias("src"), F.col("method_uid").alias("dst"), F.lit("HAS_METHOD").alias("type")).unionByName(
        fields.select(F.col("type_uid").alias("src"), F.col("field_uid").alias("dst"), F.lit("HAS_FIELD").alias("type"))).distinct()


def evidence_edges(facts: DataFrame) -> DataFrame:
    """Edges of the chunks that a type or statement (uid, evidence_chunk_ids) was read from to it."""
    chunks = F.array_distinct(F.filter("evidence_chunk_ids", lambda x: tx.strip(F.coalesce(x, F.lit(""))) != ""))
    kinds = F.array(F.lit("DESCRIBES"), F.lit("EVIDENCE_FOR"))
    return facts.select("uid", F.explode(chunks).alias("src")).select("src", F.col("uid").alias("dst"), F.explode(kinds).alias("type")).distinct()


def resolve_names(references: DataFrame, imports: DataFrame) -> DataFrame:
    """Qualified name of each reference: dotted as it is, else the file's import, else the own package."""
    one = imports.groupBy("file_path", "simple_name").agg(F.max("fqn").alias("_imported"))
    own = F.when(F.coalesce(tx.strip(F.col("package_name")), F.lit("")) != "", F.concat_ws(".", "package_name", "ref_name")).otherwise(F.col("ref_name"))
    dotted = F.when(F.contains(F.col("ref_name"), F.lit(".")), F.col("ref_name"))
    return references.join(one.withColumnRenamed("simple_name", "ref_name"), ["file_path", "ref_name"], "left").withColumn(
        "fqn", F.coalesce(dotted, F.col("_imported"), own)).drop("_imported")


def type_relationships(references: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges of types to the types they refer to; common and JDK types and self references are left out."""
    wanted = references.where(~F.col("ref_name").isin(*code.COMMON_TYPES))
    resolved = resolve_names(wanted, imports).where(~code.skipped_fqn(F.col("fqn")))
    edges = resolved.select(
        F.col("type_uid").alias("src"), F.concat_ws(":", F.lit("type"), "project_id", "fqn").alias("dst"), F.col("kind").alias("type"), "fqn")
    edges = edges.where(F.col("src") != F.col("dst"))
    dto = (F.col("type") == "USES") & (code.layer(code.simple_name(F.col("fqn")), F.lit(None)) == "DTO")
    kinds = F.when(dto, F.array(F.col("type"), F.lit("USES_DTO"))).otherwise(F.array("type"))
    return edges.select("src", "dst", F.explode(kinds).alias("type")).distinct()


def local_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls to a method of the same type by name and number of arguments; the first declared one is meant."""
    first = methods.groupBy("type_uid", "name", "arity").agg(F.min_by("method_uid", "ordinal").alias("target_uid"))
    return calls.join(first, ["type_uid", "name", "arity"]).where(F.col("method_uid") != F.col("target_uid")).select(
        F.col("method_uid").alias("src"), F.col("target_uid").alias("dst"), F.lit("CALLS").alias("type")).distinct()


def _argument_type(a: Column, parameters: Column) -> Column:
    return (
        F.when(a["kind"] == "name", F.coalesce(F.element_at(parameters, a["text"]), F.lit("?")))
        .when(a["kind"] == "string", "String").when(a["kind"] == "int", "int").when(a["kind"] == "long", "long")
        .when(a["kind"] == "boolean", "boolean").when(a["kind"] == "new", code.simple_name(a["text"])).otherwise("?"))


def scoped_calls(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """Calls through a field: target type from the field, signature inferred from the arguments."""
    scope = F.regexp_replace("scope", "^this\\.", "")
    found = calls.withColumn("name_of_field", scope).join(
        fields.select("type_uid", F.col("name").alias("name_of_field"), F.col("fqn").alias("target_fqn")), ["type_uid", "name_of_field"])
    arguments = F.transform("args", lambda a: _argument_type(a, F.col("parameters")))
    target = F.concat_ws(":", F.lit("method"), "project_id", "target_fqn", F.concat("name", F.lit("("), F.array_join(arguments, ","), F.lit(")")))
    return found.select(F.col("method_uid").alias("src"), target.alias("dst"), F.lit("CALLS").alias("type"), "target_fqn").distinct()


def signature_mappings(methods: DataFrame) -> DataFrame:
    """DTO -> domain edges for types that meet in one signature. A signature is one row, so pairs form inside it."""
    layered = F.transform(F.array_distinct("type_fqns"), lambda t: F.struct(t.alias("fqn"), code.layer(code.simple_name(t), F.lit(None)).alias("layer")))
    rows = methods.withColumn("_t", layered)
    of = lambda name: F.transform(F.filter("_t", lambda t: t["layer"] == name), lambda t: t["fqn"])
    return rows.select("project_id", F.explode(of("DTO")).alias("d"), of("Domain").alias("domains")).select(
        "project_id", "d", F.explode("domains").alias("m")).select(
        F.concat_ws(":", F.lit("type"), "project_id", "d").alias("src"), F.concat_ws(":", F.lit("type"), "project_id", "m").alias("dst"),
        F.lit("MAPS_TO").alias("type")).distinct()


def endpoints(methods: DataFrame) -> DataFrame:
    """API endpoints of annotated methods and the method that handles each."""
    c = F.col
    verb = code.http_verb(c("annotation_name"), c("annotation_text"))
    path = code.endpoint_path(code.first_quoted(c("class_annotation")), code.first_quoted(c("annotation_text")))
    return methods.withColumns({"http_method": verb, "path": path}).where(c("http_method").isNotNull()).select(
        F.concat_ws(":", F.lit("endpoint"), "project_id", "http_method", "path").alias("src"), c("method_uid").alias("dst"),
        F.lit("HANDLED_BY").alias("type"), "http_method", "path")


def table_lineage(statements: DataFrame) -> DataFrame:
    """Statement -> table edges, and those of the mapper that has the statement (MAPS_TO)."""
    q = F.explode(sqltext.statement_tables(F.col("sql"), F.col("operation"))).alias("qualified")
    access = F.when(F.col("operation") == "READ", "READS_FROM").otherwise("WRITES_TO")
    links = F.array(F.struct(F.col("statement_uid").alias("src"), access.alias("type")), F.struct(F.col("mapper_uid").alias("src"), F.lit("MAPS_TO").alias("type")))
    table = ids.table_uid(F.col("project_id"), sqltext.schema_of(F.col("qualified")), sqltext.table_of(F.col("qualified")))
    return statements.select("project_id", "statement_uid", "mapper_uid", "operation", q).select(
        F.explode(links).alias("e"), table.alias("dst")).select("e.src", "dst", "e.type").distinct()


def column_lineage(statements: DataFrame) -> DataFrame:
    """Table -> column (HAS_COLUMN) and statement -> column (REFERENCES_COLUMN) edges."""
    sql, operation = F.col("sql"), F.col("operation")
    pairs = statements.select(
        "project_id", "statement_uid", F.explode(sqltext.statement_tables(sql, operation)).alias("q"), sqltext.statement_columns(sql, operation).alias("cs")
    ).select("project_id", "statement_uid", sqltext.schema_of(F.col("q")).alias("s"), sqltext.table_of(F.col("q")).alias("t"), F.explode("cs").alias("c"))
    column = ids.column_uid(F.col("project_id"), F.col("s"), F.col("t"), F.col("c"))
    table = ids.table_uid(F.col("project_id"), F.col("s"), F.col("t"))
    links = F.array(F.struct(table.alias("src"), column.alias("dst"), F.lit("HAS_COLUMN").alias("type")),
                    F.struct(F.col("statement_uid").alias("src"), column.alias("dst"), F.lit("REFERENCES_COLUMN").alias("type")))
    return pairs.select(F.explode(links).alias("e")).select("e.*").distinct()


# XML entities and what they stand for, the ampersand last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#60;", "<"), ("&#62;", ">"), ("&#34;", '"'), ("&#39;", "'"),
    ("&#x3c;", "<"), ("&#x3e;", ">"), ("&#x3C;", "<"), ("&#x3E;", ">"), ("&#x22;", '"'), ("&#x27;", "'"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"),
)


def _unescaped(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


# What stands for an include that can't be opened, and the condition it leaves.
UNRESOLVED = ("UNRESOLVED", "unresolved-include:")
CYCLIC = ("CYCLIC", "cyclic-include:")

_FRAGMENT = "(?s)<sql\\b[^>]*?\\bid\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</sql>"
_INCLUDE = "(?s)<include\\b[^>]*?/>|<include\\b[^>]*?>.*?</include>"


def _attribute(element: Column, name: str) -> Column:
    quoted = F.regexp_extract(element, f"(?s)\\b{name}\\s*=\\s*(\"[^\"]*\"|'[^']*')", 1)
    return tx.strip(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def _pieces(text: Column) -> Column:
    """What a text is made of, in order: plain parts, and includes with their reference and properties."""
    def opened(element):
        properties = F.transform(F.regexp_extract_all(element, F.lit("(<property\\b[^>]*>)"), F.lit(1)),
                                 lambda p: F.struct(_attribute(p, "name").alias("name"), _attribute(p, "value").alias("value")))
        return F.struct(F.lit("").alias("text"), _attribute(F.regexp_extract(element, "^<include\\b[^>]*", 0), "refid").alias("refid"), properties.alias("properties"))

    nothing = F.array().cast("array<struct<name:string,value:string>>")
    plain = F.transform(F.split(text, _INCLUDE, -1), lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("refid"), nothing.alias("properties")))
    includes = F.transform(F.regexp_extract_all(text, F.lit(f"({_INCLUDE})"), F.lit(1)), opened)
    return F.filter(F.flatten(F.zip_with(plain, includes, lambda t, i: F.array(t, i))), lambda x: x.isNotNull())


def _with_values(text: Column, properties: Column) -> Column:
    """``${name}`` replaced by the values given with the includes, the innermost include first."""
    return F.aggregate(F.reverse(F.flatten(F.transform(properties, F.reverse))), text, lambda t, p: F.replace(t, F.concat(F.lit("${"), p["name"], F.lit("}")), p["value"]))


def opened_includes(blocks: DataFrame, fragments: DataFrame) -> DataFrame:
    """(file, at, block) of ``blocks`` with their includes replaced by ``fragments`` (file, name, text).

    Only references travel: a round opens all includes of one depth by a join on file and name, and what they hold gets
    its place behind theirs. The references on the way to an include are its guard: one that is among them leaves a
    mark, as does one that no fragment has. The pieces of a block are put together once, so the work is that of the
    opened text. Fragments of a file with the same name: the first counts, and ``fragments`` has it only.
    """
    guard, place = F.array().cast("array<string>"), F.array().cast("array<int>")
    values = F.array().cast("array<array<struct<name:string,value:string>>>")
    known = cut(fragments.select("file", "name", _pieces(F.col("text")).alias("inside")))
    level = blocks.select("file", "namespace", "at", place.alias("place"), guard.alias("guard"), values.alias("given"), _pieces(F.col("block")).alias("inside"))
    made = []
    while True:
        parts = cut(level.select("file", "namespace", "at", "place", "guard", "given", F.posexplode("inside").alias("n", "piece")).select(
            "file", "namespace", "at", F.array_append("place", F.col("n")).alias("place"), "guard", "given", "piece.*"))
        made.append(parts.where("refid IS NULL").select("file", "at", "place", _with_values(F.col("text"), F.col("given")).alias("text")))
        asked = parts.where("refid IS NOT NULL")
        if asked.isEmpty():
            break
        own = F.when(F.startswith("refid", F.concat("namespace", F.lit("."))), F.substr("refid", F.length("namespace") + 2)).otherwise(F.col("refid"))
        found = cut(asked.withColumn("name", own).join(known, ["file", "name"], "left").withColumn("cyclic", F.array_contains("guard", F.col("name"))))
        word = F.when(F.col("inside").isNull(), UNRESOLVED[0]).otherwise(CYCLIC[0])
        made.append(found.where("inside IS NULL OR cyclic").select(
            "file", "at", "place", F.concat(F.lit(" /* "), word, F.lit(" INCLUDE "), "refid", F.lit(" */ ")).alias("text")))
        level = found.where("inside IS NOT NULL AND NOT cyclic").select(
            "file", "namespace", "at", "place", F.array_append("guard", F.col("name")).alias("guard"),
            F.array_append("given", F.col("properties")).alias("given"), "inside")
    whole = reduce(DataFrame.unionByName, made).groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("_t"))
    return whole.select("file", "at", F.array_join(F.transform("_t", lambda t: t["text"]), "").alias("block"))


def mapper_statements(files: DataFrame) -> DataFrame:
    """Statements of mapper XML files: id, command, operation, static SQL and the conditions of dynamic parts.

    Includes of the file's own fragments are opened; one that can't be opened leaves a mark and a condition. What
    parameters decide is not expanded.
    """
    xml = F.col("content")
    body = F.regexp_replace(F.regexp_replace(xml, "(?s)<!--.*?-->", ""), "(?s)<!DOCTYPE[^>\\[]*(?:\\[.*?\\]\\s*)?>", "")
    namespace = tx.strip(F.regexp_extract("body", "<mapper\\b[^>]*?\\bnamespace\\s*=\\s*[\"']([^\"']*)", 1))
    keep = [c for c in files.columns if c != "content"]

    def parse(some):
        # As a generator's row the body is made once; the test of the namespace would make it again, in the scan's tasks.
        return some.select(*keep, F.md5("content").alias("file"), F.explode(F.array(body)).alias("body")).withColumn("namespace", namespace)

    blocks = F.regexp_extract_all("body", F.lit("(?s)(<(select|insert|update|delete)\\b[^>]*>.*?</\\2>)"), F.lit(1))
    shape = [*keep, "file", "namespace", F.posexplode(blocks).alias("at", "block")]
    holds = F.contains("block", F.lit("<include"))
    plain_rows = parse(files).select(*shape).where(~holds)

    parsed = parse(files.where(F.contains("content", F.lit("<include"))))
    rows = parsed.select(*shape).where(holds)
    with_includes = rows.select("file", "namespace", "at", "block").dropDuplicates(["file", "at"])
    names, texts = (F.regexp_extract_all("body", F.lit(_FRAGMENT), F.lit(k)) for k in (1, 2))
    entries = F.posexplode(F.zip_with(names, texts, lambda k, v: F.struct(tx.strip(k).alias("name"), v.alias("text"))))
    fragments = parsed.select("file", entries.alias("n", "e"))
    first = fragments.groupBy("file", "e.name").agg(F.min_by("e.text", "n").alias("text"))
    opened = opened_includes(with_includes, first)
    full = rows.drop("block").join(opened, ["file", "at"]).select(*plain_rows.columns)
    return _statement_columns(plain_rows.unionByName(full).drop("file", "at"))


def _statement_columns(rows: DataFrame) -> DataFrame:
    b = F.col("block")
    plain = F.regexp_replace(F.regexp_replace(b, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1"), "(?s)</?(?:select|insert|update|delete|if|where|set|trim|foreach|choose|when|otherwise|bind|selectKey)\\b[^>]*>", " ")
    plain = _unescaped(plain)
    command = F.upper(F.regexp_extract(b, "^<(\\w+)", 1))
    test = "<(?:if|when)\\b[^>]*?\\btest\\s*=\\s*(?:\"[^\"]*\"|'[^']*')"
    mark = f"/\\* (?:{UNRESOLVED[0]}|{CYCLIC[0]}) INCLUDE [^*]* \\*/"
    told = F.regexp_extract_all(b, F.lit(f"({test}|{mark})"), F.lit(1))

    def condition(t):
        quoted = F.regexp_extract(t, "(\"[^\"]*\"|'[^']*')$", 1)
        refid = F.regexp_extract(t, "INCLUDE ([^*]*) \\*/$", 1)
        return F.when(F.startswith(t, F.lit("<")), _unescaped(F.substr(quoted, F.lit(2), F.length(quoted) - 2))).otherwise(
            F.concat(F.when(F.contains(t, F.lit(UNRESOLVED[0])), UNRESOLVED[1]).otherwise(CYCLIC[1]), refid))

    out = rows.select(
        "*", tx.strip(F.regexp_extract(b, "^<\\w+[^>]*?\\bid\\s*=\\s*[\"']([^\"']*)", 1)).alias("statement_id"), command.alias("command"),
        F.when(command == "SELECT", "READ").otherwise("WRITE").alias("operation"), sqltext.normalize(plain).alias("sql"),
        F.transform(told, condition).alias("conditions"))
    return out.where((F.col("statement_id") != "") & (F.col("namespace") != "")).drop("block")


def yaml_properties(files: DataFrame) -> DataFrame:
    """Dotted keys and values of YAML files, nesting taken from the indent.

    One fold per file; ``path`` holds the open parents with their indents.
    """
    lines = F.filter(F.split("content", "\\R"), lambda s: (tx.strip(s) != "") & ~F.ltrim(s).startswith("#") & ~F.ltrim(s).startswith("-") & (F.instr(tx.strip(s), ":") > 1))
    start = F.struct(
        F.array().cast("array<struct<indent:int,key:string>>").alias("path"), F.array().cast("array<struct<key:string,value:string>>").alias("out"))

    def step(a, raw):
        indent = F.length(raw) - F.length(F.ltrim(raw))
        line = tx.strip(raw)
        cut_at = F.instr(line, ":")
        key = tx.unquote(F.substring(line, F.lit(1), cut_at - 1))
        value = tx.strip(F.substring(line, cut_at + 1, F.length(line)))
        parents = F.filter(a["path"], lambda p: p["indent"] < indent)
        full = F.array_join(F.concat(F.transform(parents, lambda p: p["key"]), F.array(key)), ".")
        leaf = F.struct(full.alias("key"), tx.strip(F.regexp_replace(value, "\\s+#.*$", "")).alias("value"))
        return F.struct(
            F.when(value == "", F.array_append(parents, F.struct(indent.alias("indent"), key.alias("key")))).otherwise(parents).alias("path"),
            F.when(value != "", F.array_append(a["out"], leaf)).otherwise(a["out"]).alias("out"))

    pairs = F.aggregate(lines, start, step, lambda a: a["out"])
    return files.select(*[c for c in files.columns if c != "content"], F.explode(pairs).alias("p")).select(
        *[c for c in files.columns if c != "content"], "p.key", "p.value")


def yaml_entities(properties: DataFrame) -> DataFrame:
    """Profiles, providers and beans a configuration names, one row each."""
    key, value = F.col("key"), F.col("value")
    lower = F.lower(key)
    profiles = F.when(lower.endswith("profiles.active") | lower.endswith("activate.on-profile"), F.filter(F.transform(
        F.split(F.translate(value, "[]", ""), ","), lambda s: tx.unquote(s)), lambda s: s != ""))
    providers = F.when(lower.endswith(".provider"), F.filter(F.array(tx.placeholder_default(value)), lambda s: tx.strip(s) != ""))
    parts = F.split(key, "\\.")
    beans = F.filter(F.transform(parts, lambda p, i: F.when(
        (F.lower(p) == "beans") & (i < F.size(parts) - 1), F.get(parts, i + 1))), lambda s: s.isNotNull())
    none = F.array().cast("array<string>")
    keep = [c for c in properties.columns if c not in ("key", "value")]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(v, none).alias("names")) for k, v in (
        ("Profile", profiles), ("Provider", providers), ("Bean", beans))])
    return properties.select(*keep, F.explode(kinds).alias("k")).select(*keep, "k.kind", F.explode("k.names").alias("name")).distinct()


def rule_type(section: Column) -> Column:
    name = F.lower(section)
    return F.when(tx.contains_any(name, ("architecture", "아키텍처", "layer", "계층")), "ARCHITECTURE").when(
        tx.contains_any(name, ("template", "템플릿")), "TEMPLATE").otherwise("CODING")


def standard_rules(documents: DataFrame) -> DataFrame:
    """Bullets of Markdown documents as rules or templates, each under its section.

    A document is split at its headings and every section unnested with its bullets, so a bullet finds
    its heading in its own row: nothing is shuffled or sorted to carry headings down.
    """
    sections = F.split("content", "\\R(?=[ \\t]*#)")

    def parsed(s):
        lines = F.transform(F.split(s, "\\R"), lambda x: tx.strip(x))
        head = F.get(lines, 0)
        titled = head.startswith("#")
        bullets = F.filter(lines, lambda x: x.rlike(BULLET))
        return F.struct(
            F.when(titled, tx.strip(F.regexp_replace(head, "^#+\\s*", ""))).otherwise("General").alias("section"),
            F.transform(bullets, lambda x: tx.strip(F.regexp_replace(x, BULLET, ""))).alias("bullets"))

    keep = [c for c in documents.columns if c != "content"]
    rows = documents.select(*keep, F.transform(sections, parsed).alias("_s"))
    before = F.aggregate(
        F.col("_s"), F.array(F.lit(0)), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + F.size(s["bullets"])))
    rows = rows.withColumn("_before", before).select(*keep, "_before", F.posexplode("_s").alias("_i", "_sec"))
    bullets = rows.select(
        *keep, F.get("_before", F.col("_i")).alias("_offset"), F.col("_sec.section").alias("section"), F.posexplode("_sec.bullets").alias("_j", "statement"))
    words = F.lower(F.concat_ws(" ", "section", "statement"))
    template = tx.contains_any(words, ("template", "템플릿", "boilerplate"))
    ordinal = F.col("_offset") + F.col("_j")
    stable = ids.name_uuid(F.concat("section", "statement", ordinal.cast("string")))
    return bullets.select(
        *keep, ordinal.cast("long").alias("ordinal"), "section", tx.abbreviate(F.col("statement"), 300, "...", inside=True).alias("statement"),
        F.when(template, "StandardTemplate").otherwise("StandardRule").alias("label"), rule_type(F.col("section")).alias("rule_type"), stable.alias("stable_id"))


def stamped(df: DataFrame, source_key: Column, file_hash: Column, at: Column, extractor: str, version: str, confidence: float,
            project_id: Column, evidence: Column) -> DataFrame:
    """Provenance columns every node and edge carries; what is still valid ends at the empty text."""
    return df.withColumns({
        "project_id": project_id, "evidence_chunk_ids": F.coalesce(evidence, F.array().cast("array<string>")),
        "source_key": source_key, "file_hash": F.coalesce(file_hash, F.lit("")), "analysis_version": F.lit(version), "valid_from": at,
        "valid_to": F.lit(""), "confidence": F.lit(confidence), "extractor": F.lit(extractor), "created_at": at,
        "graph_key": ids.graph_key(source_key)})


def json_names(texts: DataFrame, keys: tuple[str, ...], every_string: bool) -> DataFrame:
    """(id, place, name): what the JSON of ``texts`` (id, text) names, ordered by ``place``.

    Of an object the first of the keys that has a text, before what the object holds; with ``every_string`` all texts
    that aren't keys as well. Values keep their order and their kind (a text with JSON in it is a text). One level of
    nesting is taken apart at a time, so the rounds are the depth of the deepest text.
    """
    none = F.array().cast("array<struct<key:string,raw:string,kind:string>>")

    def entries(names, raw, kinds):
        return F.transform(F.arrays_zip(names.alias("n"), raw.alias("r"), kinds.alias("k")), lambda e: F.struct(
            e["n"].alias("key"), e["r"].alias("raw"), F.get(F.split(e["k"], "<"), 0).alias("kind")))

    def kinds_of(values):
        return F.transform(values, F.schema_of_variant)

    def of_key(key):
        return lambda e: (e["key"] == key) & (e["kind"] == "STRING") & (tx.strip(e["raw"]) != "")

    def opened(level):
        raw = F.col("raw")
        fields = entries(F.map_keys(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,string>")),
                         kinds_of(F.map_values(F.from_json(raw, "map<string,variant>"))))
        items = F.from_json(raw, "array<string>")
        listed = entries(F.transform(items, lambda _: F.lit(None).cast("string")), items, kinds_of(F.from_json(raw, "array<variant>")))
        return level.withColumn("inside", F.coalesce(F.when(F.ltrim(raw).startswith("{"), fields).otherwise(listed), none))

    valid = texts.where(F.try_parse_json("text").isNotNull()).select("id", F.array().cast("array<int>").alias("place"), F.col("text").alias("raw"))
    alone = valid.where((F.schema_of_variant(F.try_parse_json("raw")) == "STRING") & F.lit(every_string))
    made = [alone.select("id", "place", F.try_variant_get(F.try_parse_json("raw"), "$", "string").alias("name"))]
    level = valid.where(F.ltrim("raw").rlike("^[\\[{]"))
    while True:
        parsed = cut(opened(level).select("id", "place", "inside"))
        said = [F.get(F.filter("inside", of_key(k)), 0)["raw"] for k in keys]
        made.append(parsed.select("id", F.array_append("place", F.lit(-1)).alias("place"), F.coalesce(*said).alias("name")).where("name IS NOT NULL"))
        items = parsed.select("id", "place", F.posexplode("inside").alias("n", "e")).select("id", F.array_append("place", F.col("n")).alias("place"), "e.raw", "e.kind")
        if every_string:
            made.append(items.where("kind = 'STRING'").select("id", "place", F.col("raw").alias("name")))
        level = items.where("kind IN ('OBJECT', 'ARRAY')").select("id", "place", "raw")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, made)


def tool_names(replies: DataFrame) -> DataFrame:
    """id, tables, columns: the names in tools' replies (id, text; one row for each id)."""
    def gathered(found, name):
        return found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("_l")).select(
            "id", F.transform("_l", lambda x: x["name"]).alias(name))

    none = F.array().cast("array<string>")
    replies = cut(replies.select("id", "text"))  # read three times; what is asked of the JSON would be asked in the scan's tasks
    known = replies.join(gathered(json_names(replies, sqltext.TABLE_KEYS, True), "_tables"), "id", "left").join(
        gathered(json_names(replies, sqltext.COLUMN_KEYS, False), "_columns"), "id", "left")
    return known.select("id", sqltext.table_names(F.col("text"), F.coalesce("_tables", none)).alias("tables"),
                        sqltext.column_names(F.col("text"), F.coalesce("_columns", none)).alias("columns"))


def source_block(answers: DataFrame, requested: DataFrame) -> DataFrame:
    """First code block of an answer that declares the requested type; both carry ``answer_id``."""
    blocks = answers.select("answer_id", F.posexplode(code.code_blocks(F.col("content"))).alias("pos", "block"))
    declared = F.regexp_extract_all("block", F.lit("\\b(?:class|interface|enum|record)\\s+([A-Za-z_$][\\w$]*)"), F.lit(1))
    types = blocks.select("answer_id", "pos", "block", F.explode(F.array_distinct(declared)).alias("simple_name"))
    wanted = requested.withColumn("simple_name", code.simple_name(F.col("type_name")))
    return wanted.join(types, ["answer_id", "simple_name"]).groupBy("answer_id", "type_name").agg(F.min_by("block", "pos").alias("block"))


def invalid_columns(used: DataFrame, allowed: DataFrame) -> DataFrame:
    """Columns of generated code outside the allowed ones, compared in lower case."""
    known = allowed.select(F.lower(tx.strip(F.col("column_name"))).alias("_k")).distinct()
    return used.withColumn("_k", F.lower("column_name")).join(known, "_k", "left_anti").drop("_k")


def mentioned(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """Tools named in a message as whole words, one row per match; a name may have any characters."""
    named = tools.withColumn("name", F.lower(tx.strip(F.col("tool")))).where("name <> ''")
    texts = messages.select(F.col("message_id").alias("id"), F.lower("text").alias("text"))
    found = mentions.whole_word_mentions(texts, named.select("name").distinct()).withColumnRenamed("id", "message_id")
    return found.join(named, "name").select("message_id", "tool", "priority", "id")


def best_mention(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """The tool a message is routed to: highest priority, then smallest id."""
    return mentioned(messages, tools).groupBy("message_id").agg(
        F.min_by("tool", F.struct(-F.col("priority"), F.col("id"))).alias("tool"))


def _singular(name: Column) -> Column:
    return F.when((F.length(name) > 3) & name.endswith("s"), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def _first(df: DataFrame, key: str, limit: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy("ordinal", "table_name"))
    return df.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def _first_distinct(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The same of rows that may repeat; each task leaves the others out before anything is sent."""
    rank = F.dense_rank().over(W.partitionBy(key).orderBy("ordinal", "table_name"))
    return df.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n").distinct()


def match_tables(prompts: DataFrame, tables: DataFrame, limit: int = MATCH_LIMIT, hits: DataFrame | None = None) -> DataFrame:
    """Tables a prompt is about, at most ``limit``, from the first of three ways that finds any.

    Names in it as whole words; tables that a search for it named (``hits``: prompt_id, candidate, ordinal), by full or
    simple name; names whose parts it contains. A name may have any characters. Of the tables that one name or one
    token leads to, a prompt can show no more than ``limit``, so no more are carried.
    """
    named = cut(tables.withColumn("simple", F.lower(tx.strip(sqltext.table_of(F.col("table_name"))))).where("simple <> ''"))
    few = _first(named, "simple", limit)
    texts = prompts.select(F.col("prompt_id").alias("id"), F.lower("text").alias("text"))
    exact = mentions.whole_word_mentions(texts, named.select(F.col("simple").alias("name")).distinct()).withColumnRenamed("name", "simple")
    exact = cut(_first_distinct(exact.join(few, "simple").select(F.col("id").alias("prompt_id"), "table_name", "ordinal"), "prompt_id", limit))
    done, out = exact.select("prompt_id").distinct(), exact.withColumn("kind", F.lit("word"))
    if hits is not None:
        searched = cut(_first(_available(hits.join(done, "prompt_id", "left_anti"), named), "prompt_id", limit))
        out = out.unionByName(searched.withColumn("kind", F.lit("search")))
        done = done.unionByName(searched.select("prompt_id").distinct())

    simple = F.col("simple")
    bare = F.replace(simple, F.lit("_"), F.lit(""))
    tokens = F.filter(F.split(simple, "_"), lambda t: (F.length(t) >= TOKEN_MIN) & ~t.isin(*sqltext.IGNORED_TABLE_TOKENS))
    names = F.concat(F.array(simple, bare, _singular(simple), _singular(bare)), tokens, F.transform(tokens, _singular))
    parts = few.select("table_name", "ordinal", F.explode(F.array_distinct(F.filter(names, lambda n: tx.strip(n) != ""))).alias("part"))
    rest = cut(texts.join(done.withColumnRenamed("prompt_id", "id"), "id", "left_anti"))
    held = mentions.contained(rest, parts.select("part").distinct())
    over_several = F.rlike("part", F.lit("\\s"))
    one, several = held.where(~over_several), held.where(over_several)
    leads = one.select("token", "part").distinct().join(parts, "part").select("token", "table_name", "ordinal").distinct()
    loose = one.select("id", "token").distinct().join(_first(leads, "token", limit), "token").unionByName(
        several.join(parts, "part").select("id", "token", "table_name", "ordinal"))
    loose = loose.select(F.col("id").alias("prompt_id"), "table_name", "ordinal")
    return out.unionByName(_first_distinct(loose, "prompt_id", limit).withColumn("kind", F.lit("contains")))


def _available(hits: DataFrame, named: DataFrame) -> DataFrame:
    """(prompt_id, table_name, ordinal): for each candidate the first table of its full or simple name.

    Where there are no tables to choose from, the candidates themselves.
    """
    if named.isEmpty():
        return hits.groupBy("prompt_id", F.col("candidate").alias("table_name")).agg(F.min("ordinal").alias("ordinal")).where(tx.strip(F.col("table_name")) != "")
    wanted = hits.withColumn("simple", F.lower(tx.strip(sqltext.table_of(F.col("candidate")))))
    first = named.groupBy("simple").agg(F.min_by("table_name", F.struct("ordinal", "table_name")).alias("table_name"))
    return wanted.join(first, "simple").groupBy("prompt_id", "table_name").agg(F.min("ordinal").alias("ordinal"))


def reconcile(current: DataFrame, live: DataFrame) -> DataFrame:
    """Configured capabilities against the live tools: retained, removed, or newly added."""
    names = live.select(tx.strip(F.col("tool")).alias("tool")).where(F.col("tool") != "").distinct().withColumn("_live", F.lit(True))
    joined = current.select("capability_id", "tool", F.lit(True).alias("_known")).join(names, "tool", "full")
    action = F.when(F.col("_known").isNull(), "added").when(F.col("_live").isNull(), "removed").otherwise("retained")
    told = joined.select("capability_id", "tool", action.alias("action"))
    kept = told.where("capability_id IS NOT NULL")
    plain = F.regexp_replace(F.regexp_replace(F.lower("tool"), "[^a-z0-9]+", "."), "^\\.+|\\.+$", "")
    named = told.where("capability_id IS NULL").withColumn(
        "wanted", F.concat(F.lit("auto."), F.when(plain == "", "tool").otherwise(plain)))
    # Tools of one id are told apart by a hash of their name, all but the first by name; so are those of an id in use.
    place = F.row_number().over(W.partitionBy("wanted").orderBy("tool"))
    used = kept.where("action = 'retained'").select(F.col("capability_id").alias("wanted"), F.lit(True).alias("_used"))
    own = F.concat_ws(".", "wanted", F.lower(F.conv(_java_hash(F.col("tool")).cast("string"), 10, 36)))
    new = named.withColumn("_place", place).join(used, "wanted", "left").select(
        F.when((F.col("_place") > 1) | F.col("_used").isNotNull(), own).otherwise(F.col("wanted")).alias("capability_id"), "tool", "action")
    return kept.unionByName(new)


def _java_hash(text: Column) -> Column:
    """Unsigned 32-bit hash with factor 31 over the characters (of the basic plane)."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"),
                       lambda h, c: F.pmod(h * 31 + F.ascii(c).cast("long"), F.lit(1 << 32)))


def living_references(references: DataFrame, reconciled: DataFrame) -> DataFrame:
    """References between capabilities that were both retained."""
    kept = reconciled.where(F.col("action") == "retained").select("capability_id")
    return references.join(kept, "capability_id", "left_semi").join(
        kept.withColumnRenamed("capability_id", "reference_id"), "reference_id", "left_semi").select("capability_id", "reference_id")


def rule_evidence(history: DataFrame) -> DataFrame:
    """BASED_ON edges of generations to the documents they were given, with the rule nodes' names and sources."""
    given = history.select("id", "project_id", F.explode(tx.json_list(F.col("rag_documents"))).alias("d")).where(tx.strip(F.col("d")) != "")
    first_line = F.get(F.split(F.regexp_replace("d", "^\\s+|\\s+$", ""), "\\R"), 0)
    source = tx.strip(F.regexp_extract("d", "(?s)\\[source:([^\\]]*)\\]", 1))
    has = F.rlike("d", F.lit("(?s)\\[source:[^\\]]*\\]"))
    return given.select(
        F.concat(F.lit("generation:"), F.col("id").cast("string")).alias("src"),
        F.concat_ws(":", F.lit("rule"), "project_id", ids.name_uuid(F.col("d"))).alias("dst"), F.lit("BASED_ON").alias("type"),
        F.substring(first_line, 1, 160).alias("name"), F.when(has, source).otherwise("generation-rag").alias("source_key"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
