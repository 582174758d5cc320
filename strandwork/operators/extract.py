"""Rows out of source files and documents: imports, exports, declarations, routes, settings, headings, requirements.

Everything here is a regular expression inside the JVM over one pass of the text; nothing leaves the scan's partition.
files has (file_id, file_path, content); the language is the one the extension stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.text import extension, language_of

JS = ("TypeScript", "JavaScript")


def _all(pattern: str, group: int = 1, text: str = "content") -> Column:
    # only a line feed ends a line, as in other regular-expression libraries
    return F.regexp_extract_all(F.col(text), F.lit(pattern.replace("(?m)", "(?md)")), group)


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("v"))


def _rows(files: DataFrame, rules: list[tuple[tuple[str, ...] | None, str, str]], value: str) -> DataFrame:
    """(file_id, kind, value): each match of each rule (languages or None for all, kind, pattern with one group)."""
    f = files.where("content is not null").withColumn("_lang", language_of("file_path"))
    parts = []
    for langs, kind, pattern in rules:
        found = F.transform(_all(pattern), _tagged(kind))
        parts.append(found if langs is None else F.when(F.col("_lang").isin(*langs), found).otherwise(F.array().cast("array<struct<kind:string,v:string>>")))
    out = f.select("file_id", F.explode(F.concat(*parts)).alias("m"))
    return out.select("file_id", F.col("m.kind").alias("kind"), F.col("m.v").alias(value))


# How the languages write what is looked for.
IMPORTS = [
    (JS, "import", r"(?m)^import\s[^;'\"]*?from\s+['\"]([^'\"]+)['\"]"), (JS, "side_effect", r"(?m)^import\s+['\"]([^'\"]+)['\"]"), (JS, "require", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    (JS, "re_export", r"(?m)^export\s[^;'\"]*?from\s+['\"]([^'\"]+)['\"]"), (("Python",), "import", r"(?m)^import[ \t]+([\w.]+)"), (("Python",), "from", r"(?m)^from[ \t]+([\w.]+)[ \t]+import\b"),
    (("Rust",), "use", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([\w:]+)"), (("Rust",), "mod", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;"), (("Ruby",), "require", r"(?m)^[ \t]*require(?:_relative)?[ \t]*\(?['\"]([^'\"]+)['\"]"),
    (("C++", "C"), "system", r"(?m)^[ \t]*#[ \t]*include[ \t]*<([^>\n]+)>"), (("C++", "C"), "include", r"(?m)^[ \t]*#[ \t]*include[ \t]*\"([^\"\n]+)\""), (("Swift",), "import", r"(?m)^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:(?:struct|class|enum|protocol|func|var)[ \t]+)?([\w.]+)"),
    (("Java",), "import", r"(?m)^import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?);"), (("Go",), "import", r"(?m)^import[ \t]+(?:\w+[ \t]+)?\"([^\"]+)\""),
]
EXPORTS = [
    (JS, "function", r"(?m)^export\s+(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), (JS, "class", r"(?m)^export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    (JS, "const", r"(?m)^export\s+(?:const|let|var)\s+(\w+)"), (JS, "interface", r"(?m)^export\s+interface\s+(\w+)"), (JS, "type", r"(?m)^export\s+type\s+(\w+)"), (JS, "enum", r"(?m)^export\s+(?:const\s+)?enum\s+(\w+)"),
    (("Python",), "function", r"(?m)^(?:async[ \t]+)?def[ \t]+([A-Za-z]\w*)"), (("Python",), "class", r"(?m)^class[ \t]+([A-Za-z]\w*)"), (("Python",), "const", r"(?m)^([A-Z][A-Z0-9_]+)[ \t]*="),
    (("Java",), "class", r"(?m)^[ \t]*public[ \t]+(?:abstract[ \t]+|final[ \t]+|static[ \t]+)*(?:class|interface|enum|record)[ \t]+(\w+)"),
    (("Go",), "function", r"(?m)^func[ \t]+(?:\([^)]*\)[ \t]*)?([A-Z]\w*)"), (("Go",), "type", r"(?m)^type[ \t]+([A-Z]\w*)"),
    (("Rust",), "function", r"(?m)^pub[ \t]+(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*fn[ \t]+(\w+)"), (("Rust",), "type", r"(?m)^pub[ \t]+(?:struct|enum|trait|type)[ \t]+(\w+)"), (("Swift",), "declaration", r"(?m)^(?:public|open)[ \t]+(?:final[ \t]+)?(?:func|class|struct|enum|protocol|actor)[ \t]+(\w+)"),
    (("Ruby",), "class", r"(?m)^[ \t]*(?:class|module)[ \t]+([A-Z][\w:]*)"),
]
DECLARATIONS = [
    (JS, "function", r"(?m)^(?:export\s+)?(?:default\s+)?((?:async\s+)?function\*?\s+\w+\s*\([^)]*\)[^{\n]*)\{"), (JS, "arrow", r"(?m)^(?:export\s+)?(const\s+\w+[^=\n]*=\s*(?:async\s*)?\([^)]*\)[^=\n]*=>)"),
    (JS, "interface", r"(?m)^(?:export\s+)?(interface\s+\w+[^{\n]*)\{"), (JS, "class", r"(?m)^(?:export\s+)?(class\s+\w+[^{\n]*)\{"), (("Python",), "function", r"(?m)^[ \t]*((?:async[ \t]+)?def[ \t]+\w+\([^)]*\)[^:\n]*):"),
    (("Python",), "class", r"(?m)^(class[ \t]+\w+[^:\n]*):"), (("Go",), "function", r"(?m)^(func[ \t]+[^{\n]+)\{"), (("Go",), "type", r"(?m)^(type[ \t]+\w+[ \t]+(?:struct|interface))"),
    (("Java",), "method", r"(?m)^[ \t]+((?:(?:public|private|protected|static|final|abstract|synchronized)[ \t]+)*[\w<>\[\], ]+[ \t]+\w+\([^)]*\)[^{;\n]*)\{"), (("Java",), "class", r"(?m)^[ \t]*((?:public[ \t]+)?(?:class|interface|enum|record)[ \t]+\w+[^{\n]*)\{"),
    (("Rust",), "function", r"(?m)^[ \t]*((?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*fn[ \t]+\w+[^{;\n]*)[{;]"), (("Rust",), "type", r"(?m)^[ \t]*((?:pub(?:\([^)]*\))?[ \t]+)?(?:struct|enum|trait|impl)\b[^{;\n]*)[{;]"),
    (("Ruby",), "method", r"(?m)^[ \t]*(def[ \t]+[\w.?!=]+(?:\([^)\n]*\))?)"), (("Ruby",), "class", r"(?m)^[ \t]*((?:class|module)[ \t]+[A-Z][^\n]*)"),
    (("C++", "C"), "function", r"(?m)^((?:[\w:*&<>,]+[ \t]+)+[*&]*[\w:~]+\([^;{)\n]*\)[^;{\n]*)\{"), (("C++", "C"), "type", r"(?m)^((?:class|struct|union|namespace|enum(?:[ \t]+class)?)[ \t]+\w+[^;{\n]*)\{"),
    (("Swift",), "function", r"(?m)^[ \t]*((?:(?:public|private|internal|open|static|override|mutating|final)[ \t]+)*(?:func[ \t]+\w+|init)[^{\n]*)\{"), (("Swift",), "type", r"(?m)^[ \t]*((?:(?:public|private|internal|open|final)[ \t]+)*(?:class|struct|enum|protocol|extension|actor)[ \t]+\w+[^{\n]*)\{"),
]
ENVIRONMENT = [
    (JS, "reference", r"\bprocess\.env\.([A-Z][A-Z0-9_]*)"), (JS, "reference", r"\bprocess\.env\[['\"]([A-Z][A-Z0-9_]*)['\"]\]"), (("Python",), "reference", r"\bos\.environ(?:\.get\(|\[)\s*['\"]([A-Z][A-Z0-9_]*)['\"]"),
    (("Python",), "reference", r"\bos\.getenv\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]"), (("Go",), "reference", r"\bos\.(?:Getenv|LookupEnv)\(\"([A-Z][A-Z0-9_]*)\""), (("Java",), "reference", r"\bSystem\.getenv\(\"([A-Z][A-Z0-9_]*)\""),
]
ROUTES = [
    (JS, "express", r"\b(?:app|router|server|api)\.(?:get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)['\"`]"), (JS, "nest", r"@(?:Get|Post|Put|Patch|Delete)\(\s*['\"]([^'\"]*)['\"]"),
    (("Python",), "decorator", r"@\w+\.(?:get|post|put|patch|delete|route)\(\s*['\"]([^'\"]+)['\"]"), (("Java",), "spring", r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)\""), (("Go",), "handle", r"\.(?:HandleFunc|Handle|GET|POST|PUT|DELETE)\(\s*\"([^\"]+)\""),
]
HTTP_CALLS = [(JS, "fetch", r"\bfetch\(\s*['\"`]([^'\"`]+)['\"`]"), (JS, "client", r"\b(?:axios|ky|got|http)(?:\.(?:get|post|put|patch|delete))?\(\s*['\"`]([^'\"`]+)['\"`]"), (("Python",), "requests", r"\brequests\.(?:get|post|put|patch|delete)\(\s*f?['\"]([^'\"]+)['\"]")]
SCHEMAS = [(JS, "typeorm", r"@Entity\([^)]*\)\s*(?:export\s+)?class\s+(\w+)"), (JS, "drizzle", r"\b(?:pg|mysql|sqlite)Table\(\s*['\"](\w+)['\"]"), (("Python",), "sqlalchemy", r"__tablename__\s*=\s*['\"](\w+)['\"]"), (None, "prisma", r"(?m)^model\s+(\w+)\s*\{")]
MIDDLEWARE = [(JS, "use", r"\b(?:app|router)\.use\(\s*(\w+)"), (JS, "guard", r"@UseGuards\(\s*(\w+)"), (("Python",), "add", r"\.add_middleware\(\s*(\w+)")]
# a component's text ends where a line begins with its closing brace
COMPONENTS = [(JS, "react", r"(?m)^(?:export\s+)?(?:default\s+)?(function\s+[A-Z]\w*\s*\([^)]*\)[^{]*\{(?:[^\n]*\}[ \t\r]*$|[\s\S]*?^\}))"), (JS, "angular", r"@Component\([\s\S]*?\)\s*(?:export\s+)?(?:default\s+)?(class\s+\w+)")]
MARKUP = r"return\s*\(?\s*<|^class\s"
TESTS = [(JS, "title", r"\b(?:it|test|describe)\(\s*['\"`]([^'\"`]+)['\"`]"), (("Python",), "title", r"(?m)^[ \t]*def[ \t]+(test_\w+)"), (("Go",), "title", r"(?m)^func[ \t]+(Test\w+)")]
PARENTS = [(JS, "extends", r"\bclass\s+\w+\s+extends\s+(\w+)"), (JS, "implements", r"\bclass\s+\w+(?:\s+extends\s+\w+)?\s+implements\s+(\w+)"), (("Python",), "extends", r"(?m)^class[ \t]+\w+\((\w+)"), (("Java",), "extends", r"\bclass\s+\w+\s+extends\s+(\w+)"), (("Java",), "implements", r"\bclass\s+\w+(?:\s+extends\s+\w+)?\s+implements\s+(\w+)")]


def imports(files: DataFrame) -> DataFrame:
    """(file_id, kind, source)"""
    return _rows(files, IMPORTS, "source")


def exports(files: DataFrame) -> DataFrame:
    """(file_id, kind, name)"""
    return _rows(files, EXPORTS, "name")


def declarations(files: DataFrame) -> DataFrame:
    """(file_id, kind, signature), white space squeezed."""
    return _rows(files, DECLARATIONS, "signature").withColumn("signature", F.trim(F.regexp_replace("signature", r"\s+", " ")))


def rule_matches(files: DataFrame, rules: list) -> DataFrame:
    """(file_id, kind, name) for any of the rule tables above."""
    return _rows(files, rules, "name")


def components(files: DataFrame) -> DataFrame:
    """(file_id, kind, name): functions that return markup, whatever their length, and classes with a component's decorator."""
    c = _rows(files, COMPONENTS, "code").where(F.col("code").rlike(MARKUP))
    return c.select("file_id", "kind", F.regexp_extract("code", r"^\w+\s+(\w+)", 1).alias("name"))


def environment(files: DataFrame) -> DataFrame:
    """(name, n_files): settings read from the environment, merged over files."""
    return _rows(files, ENVIRONMENT, "name").groupBy("name").agg(F.count_distinct("file_id").alias("n_files"))


def imported_names(files: DataFrame) -> DataFrame:
    """(file_id, source, name, local): the names that JavaScript and TypeScript files import in braces, and what they are
    called there; ``type`` before a name is left away."""
    found = _all(r"(?m)^[ \t]*import\s+(?:type\s+)?(?:\w+\s*,\s*)?(\{[^}]*\}\s*from\s*['\"][^'\"]+['\"])")
    f = files.where("content is not null").where(language_of("file_path").isin(*JS)).select("file_id", F.explode(found).alias("m"))
    part = f.select("file_id", F.regexp_extract("m", r"from\s*['\"]([^'\"]+)['\"]$", 1).alias("source"), F.explode(F.split(F.regexp_extract("m", r"^\{([^}]*)\}", 1), ",")).alias("p"))
    p = F.regexp_replace(F.trim(F.regexp_replace("p", r"\s+", " ")), "^type ", "")
    return part.select("file_id", "source", F.regexp_extract(p, r"^([\w$]+)", 1).alias("name"), F.regexp_extract(p, r"([\w$]+)$", 1).alias("local")).where("name <> ''")


def declared_packages(files: DataFrame) -> DataFrame:
    """(file_id, file_path, package) of Java and Go files."""
    f = files.where("content is not null").where(language_of("file_path").isin("Java", "Go"))
    return f.select("file_id", "file_path", F.regexp_extract("content", r"(?md)^[ \t]*package[ \t]+([\w.]+)", 1).alias("package")).where("package <> ''")


def resolved_java_imports(files: DataFrame) -> DataFrame:
    """(file_id, source, target_id): imports of Java classes with the file of that package and name, the smallest of several."""
    i = imports(files.where(language_of("file_path") == "Java")).where("source not like '%*'").select("file_id", "source").distinct()
    own = declared_packages(files).where(language_of("file_path") == "Java")
    own = own.select(F.concat("package", F.lit("."), F.regexp_extract("file_path", r"([^/]*)\.[^./]*$", 1)).alias("source"), F.col("file_id").alias("target_id"))
    return i.join(own, "source").groupBy("file_id", "source").agg(F.min("target_id").alias("target_id"))


def plain_path(path: Column) -> Column:
    """A path without '.' and '..' segments, however many; those that lead out of the root stay away."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin(".", ""), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved_imports(files: DataFrame) -> DataFrame:
    """(file_id, source, target_id): relative imports with the file they lead to.

    A specifier is tried as it stands, with other extensions for its own and as a folder's index; the first that exists wins.
    """
    i = imports(files).where("kind in ('import', 'require', 're_export') and source like '.%'").distinct()
    own = files.select("file_id", F.regexp_replace("file_path", "/[^/]*$", "").alias("dir"))
    i = i.join(own, "file_id").withColumn("path", F.concat_ws("/", "dir", "source"))
    i = i.withColumn("path", plain_path(F.col("path")))
    bare = F.regexp_replace("path", r"\.(?:js|jsx|mjs|cjs|ts|tsx|mts)$", "")
    options = F.array(F.col("path"), *[F.concat(bare, F.lit(x)) for x in (".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")])
    c = i.select("file_id", "source", F.posexplode(options).alias("pos", "option"))
    hit = c.join(files.select(F.col("file_id").alias("target_id"), F.col("file_path").alias("option")), "option")
    return hit.groupBy("file_id", "source").agg(F.min(F.struct("pos", "target_id")).alias("m")).select("file_id", "source", F.col("m.target_id").alias("target_id"))


# -- documents -----------------------------------------------------------------------------------------------------


def headings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, level, title): headings outside fenced code, in order."""
    plain = F.regexp_replace(text, r"(?s)```.*?(?:```|$)", "")
    h = F.regexp_extract_all(plain, F.lit(r"(?m)^(#{1,6}[ \t]+[^\r\n]+)"), 1)
    return docs.where(F.col(text).isNotNull()).select(doc_id, F.posexplode(h).alias("pos", "h")).select(
        doc_id, "pos", F.length(F.regexp_extract("h", "^#+", 0)).alias("level"), F.trim(F.regexp_replace("h", r"^#+[ \t]+", "")).alias("title")
    )


def requirements(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, kind, name): requirements and scenarios of specifications."""
    h = headings(docs, doc_id, text).where(F.col("title").rlike(r"^(?:Requirement|Scenario):"))
    return h.select(doc_id, "pos", F.lower(F.regexp_extract("title", r"^(\w+):", 1)).alias("kind"), F.regexp_extract("title", r"^\w+:[ \t]*(.*)$", 1).alias("name"))


def decision_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, number, title, n_sections): records that open with an ADR heading."""
    h = headings(docs, doc_id, text)
    head = h.where((F.col("level") == 1) & F.col("title").rlike(r"^ADR-\d+:")).groupBy(doc_id).agg(F.min(F.struct("pos", "title")).alias("m"))
    n = h.where("level = 2").groupBy(doc_id).agg(F.count(F.lit(1)).alias("n_sections"))
    title = F.col("m.title")
    return head.join(n, doc_id, "left").select(
        doc_id, F.regexp_extract(title, r"^ADR-0*(\d+):", 1).cast("long").alias("number"), F.regexp_extract(title, r"^ADR-\d+:[ \t]*(.*)$", 1).alias("title"), F.coalesce("n_sections", F.lit(0)).alias("n_sections")
    )


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_chars: int = 8000, overlap: int = 10) -> DataFrame:
    """(doc_id, chunk_no, chunk): texts cut at blank lines once they reach max_chars, each chunk beginning with the last
    ``overlap`` lines of the one before. A text up to max_chars is one chunk. Nothing is lost, whatever the length.

    In Arrow batches: each line is looked at once, which no fold over arrays in an expression would do.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, c) for i, x in zip(b[doc_id], b[text]) for n, c in enumerate(cut_at_blank_lines(x, max_chars, overlap))]
            yield pd.DataFrame(rows, columns=[doc_id, "chunk_no", "chunk"])

    return docs.where(F.col(text).isNotNull()).select(doc_id, text).mapInPandas(run, f"`{doc_id}` {kind}, chunk_no int, chunk string")


def cut_at_blank_lines(text: str, max_chars: int, overlap: int) -> Iterator[str]:
    if len(text) <= max_chars:
        yield text
        return
    lines: list[str] = []
    first, n, any_done = 0, 0, False
    for line in text.split("\n"):
        lines.append(line)
        full = n + len(line) + 1 >= max_chars and not line.strip(" ") and len(lines) - first > 1
        n += len(line) + 1
        if full:
            yield "\n".join(lines[first:])
            any_done = True
            first, n = max(first, len(lines) - overlap), 0
    if not any_done or len(lines) - first > overlap:
        yield "\n".join(lines[first:])
