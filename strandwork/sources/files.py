"""Sources and sinks: source trees, line logs, package manifests, change sets; graphs as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions.text import base_name, directory, extension, glob_pattern, path_flags

# Folders that are never entered, hidden folders that are, folders skipped below the root, and endings and
# names of files that hold nothing to read.
SKIPPED = ("node_modules", "dist", "build", "out", "target", "bin", "obj", "__pycache__", "coverage", "vendor", "storybook-static", "cdk.out", "android", "ios")
HIDDEN_ENTERED = (".github", ".gitlab", ".circleci", ".azure")
SKIPPED_BELOW = ("deps", "packages")
SKIPPED_ENDS = (
    ".lock .lockb .min.js .min.css .bundle.js .chunk.js .map .png .jpg .jpeg .gif .svg .ico .webp .bmp .woff .woff2 .ttf .eot .otf .mp3 .mp4 .wav .avi .mov .webm .pdf .doc .docx .xls .xlsx "
    ".zip .tar .gz .rar .7z .pyc .pyo .class .o .so .dll .exe"
).split()
SKIPPED_NAMES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", ".DS_Store", "Thumbs.db")
#: Files above this size have their lines left uncounted.
LARGE = 10_000_000


def skipped(path: Column, ignore: tuple[str, ...] = (), include: tuple[str, ...] = (), below: tuple[str, ...] = SKIPPED_BELOW) -> Column:
    """Whether a relative path lies in a skipped or hidden folder, is of a skipped kind or matches an ignored glob;
    included globs win over the last."""
    any_of = lambda words: "|".join(re.escape(w) for w in words)
    c = path.rlike(rf"(?:^|/)(?:{any_of(SKIPPED)})/") | path.rlike(rf"(?:^|/)(?!(?:{any_of(HIDDEN_ENTERED)})/)\.[^/]+/")
    c = c | path.rlike(rf"(?i)(?:{any_of(SKIPPED_ENDS)})$") | path.rlike(rf"(?:^|/)(?:{any_of(SKIPPED_NAMES)})$")
    if below:
        c = c | path.rlike(rf"/(?:{any_of(below)})/")
    if ignore:
        g = path.rlike("|".join(map(glob_pattern, ignore)))
        c = c | (g & ~path.rlike("|".join(map(glob_pattern, include))) if include else g)
    return c


def walk(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), include: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """One row per file below root: path, name, extension, directory, depth, size, modified, lines, flags.

    Paths are filtered before any content is read; without content only shebangs and line counts need it. Files whose
    name begins with a dot or underscore are not listed by Spark's file sources.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    f = raw.withColumn("full", F.col("path")).withColumn("path", rel).where(~skipped(F.col("path"), ignore, include))
    text = F.decode("content", "utf-8")
    flags = path_flags("path")
    out = f.select(
        "path", base_name("path").alias("name"), extension("path").alias("extension"), directory("path").alias("directory"), (F.size(F.split("path", "/")) - 1).alias("depth"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.when(F.col("length") > LARGE, -1).when(F.col("length") == 0, 0).otherwise(F.size(F.split(text, "\n"))).alias("lines"),
        flags["is_test"].alias("is_test"), flags["is_config"].alias("is_config"), flags["is_generated"].alias("is_generated"), (flags["is_entry_point"] | text.startswith("#!")).alias("is_entry_point"),
        F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), text.alias("content"),
    )
    return out if content else out.drop("content")


def fingerprint(files: DataFrame) -> DataFrame:
    """(n_files, fingerprint): a hash that changes with any path, time or size. Rows are hashed each for itself and summed,
    so no task holds the list of all files."""
    row = F.xxhash64("path", F.col("modified").cast("string"), "size").cast("decimal(38,0)")
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.sum(row).cast("string"), 256).alias("fingerprint"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A line log of JSON; lines that are no JSON of the schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stream_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def overwrite(df: DataFrame, path: str, keep: int = 1) -> None:
    """Write the rows as a new version below path, then name it current in one rename; readers (read_current) see the old
    rows or the new ones, never none. Versions before the last ``keep`` are deleted."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = p(path).getFileSystem(conf)
    old = _versions(fs, p(path))
    version = (old[-1] if old else 0) + 1
    df.write.parquet(f"{path}/v{version:012d}")
    # a marker appears at once: the greatest one names the current version
    fs.mkdirs(p(f"{path}/_current"))
    fs.create(p(f"{path}/_current/.{version}"), True).close()
    fs.rename(p(f"{path}/_current/.{version}"), p(f"{path}/_current/{version}"))
    for v in old[:-keep] if keep else old:
        fs.delete(p(f"{path}/_current/{v}"), False)
        fs.delete(p(f"{path}/v{v:012d}"), True)


def _versions(fs, path) -> list[int]:
    marks = path.suffix("/_current")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(marks) if f.getPath().getName().isdigit()) if fs.exists(marks) else []


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that overwrite() wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    versions = _versions(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{versions[-1]:012d}")


# -- change sets (column value: one line) --------------------------------------------------------------------------


def name_status(lines: DataFrame) -> DataFrame:
    """(path, status, old_path) from lines of a name-status listing; a copy counts as added."""
    p = F.split("value", "\t")
    code = F.substring(p[0], 1, 1)
    status = F.when(code == "A", "added").when(code == "M", "modified").when(code == "D", "deleted").when(code == "R", "renamed").when(code == "C", "added").otherwise("modified")
    two = code.isin("R", "C")
    return lines.where(F.col("value").rlike(r"^[A-Z]\d*\t")).select(F.when(two, F.try_element_at(p, F.lit(3))).otherwise(p[1]).alias("path"), status.alias("status"), F.when(code == "R", p[1]).alias("old_path"))


def numstat(lines: DataFrame) -> DataFrame:
    """(path, additions, deletions) from lines of a numstat listing; binary files count 0; renames give the new path."""
    p = F.split("value", "\t")
    path = F.regexp_replace(p[2], r"\{[^{}]* => ([^{}]*)\}", "$1")
    path = F.regexp_replace(F.regexp_replace(path, r"^.* => ", ""), "//+", "/")
    n = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(0))
    return lines.where(F.col("value").rlike(r"^(?:\d+|-)\t(?:\d+|-)\t")).withColumn("a", p[0]).withColumn("b", p[1]).select(path.alias("path"), n("a").alias("additions"), n("b").alias("deletions"))


def changed_files(status: DataFrame, stat: DataFrame) -> DataFrame:
    """name_status joined with numstat and the flags of the path, as changes for drift()."""
    flags = path_flags("path")
    both = status.join(stat, "path", "left").fillna(0, ["additions", "deletions"])
    return both.withColumn("n_changes", F.col("additions") + F.col("deletions")).withColumn("is_test", flags["is_test"]).withColumn("is_config", flags["is_config"]).withColumn("is_generated", flags["is_generated"])


def diff_hunks(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """(path, start, end, added): the new side of every hunk of unified diffs; a pure removal has end = start."""
    sections = F.filter(F.split(text, r"(?m)^(?=diff --git )"), lambda s: s.startswith("diff --git "))
    s = diffs.select(F.explode(sections).alias("s")).withColumn("path", F.regexp_extract("s", r"(?m)^\+\+\+ b/(.*?)\r?$", 1)).where("path <> ''")
    h = s.select("path", F.explode(F.filter(F.split("s", r"(?m)^(?=@@ -)"), lambda x: x.startswith("@@ -"))).alias("h"))
    start, count = F.regexp_extract("h", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int"), F.regexp_extract("h", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    n = F.when(count == "", F.lit(1)).otherwise(F.expr("try_cast(nullif(regexp_extract(h, '^@@ -[0-9]+(?:,[0-9]+)? [+][0-9]+,([0-9]+)', 1), '') as int)"))
    added = F.transform(F.filter(F.split("h", "\n"), lambda x: x.startswith("+")), lambda x: F.substring(x, 2, 1_000_000_000))
    return h.select("path", start.alias("start"), (start + F.greatest(n, F.lit(1)) - 1).alias("end"), added.alias("added"))


def change_kind(added: Column) -> Column:
    """'signature' where an added line declares something, 'config' where it sets a constant, else 'logic'."""
    sig = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|def|func|public|private|protected)\b"
    const = r"^\s*(?:export\s+)?(?:const|let|var|static final)?\s*[A-Z][A-Z0-9_]*\s*[:=]"
    return F.when(F.exists(added, lambda x: x.rlike(sig)), "signature").when(F.exists(added, lambda x: x.rlike(const)), "config").otherwise("logic")


# -- package manifests (path, content) -----------------------------------------------------------------------------


def packages(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version, is_dev) of npm, pip, poetry, cargo and go manifests."""
    n = base_name("path")
    maps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    npm = files.where(n == "package.json").withColumn("j", maps)
    parts = [npm.select("path", F.lit("npm").alias("ecosystem"), F.explode(f"j.{k}").alias("name", "version"), F.lit(k == "devDependencies").alias("is_dev")) for k in ("dependencies", "devDependencies", "peerDependencies")]
    lines = files.where(n.rlike(r"^(?:requirements[^/]*\.txt|pyproject\.toml|Cargo\.toml|go\.mod)$")).select("path", n.alias("n"), F.posexplode(F.split("content", r"\r?\n")).alias("i", "line"))
    from pyspark.sql import Window

    head = F.last(F.when(F.col("line").rlike(r"^\s*\["), F.regexp_extract("line", r"^\s*\[+([^\]]+)\]", 1)), True).over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("head", F.coalesce(head, F.lit("")))
    rule = lambda where, eco, name, version, dev=F.lit(False): lines.where(where).select("path", F.lit(eco).alias("ecosystem"), name.alias("name"), version.alias("version"), dev.alias("is_dev")).where("name <> ''")
    ex = lambda p, g: F.regexp_extract("line", p, g)
    req = r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===)[^;#]*)?"
    toml = r"^\s*\"?([\w.-]+)\"?\s*=\s*(?:\"([^\"]*)\"|\{.*?version\s*=\s*\"([^\"]*)\")"
    parts += [
        rule(F.col("n").startswith("requirements") & ~F.col("line").rlike(r"^\s*(?:#|-|$)"), "pip", ex(req, 1), F.trim(ex(req, 2))),
        rule((F.col("n") == "pyproject.toml") & F.col("head").rlike(r"^tool\.poetry\..*dependencies$") & ~F.col("line").rlike(r"^\s*python\s*="), "pip", ex(toml, 1), F.concat(ex(toml, 2), ex(toml, 3)), F.col("head").contains("dev")),
        rule((F.col("n") == "pyproject.toml") & F.col("line").rlike(r"^\s*\"[A-Za-z0-9][\w.-]*[^\"=]*\"\s*,?\s*$|^\s*\"[A-Za-z0-9][\w.-]*\s*[=<>!~]"), "pip", ex(r"^\s*\"([A-Za-z0-9][\w.-]*)", 1), F.trim(ex(r"^\s*\"[A-Za-z0-9][\w.-]*(?:\[[^\]]*\])?\s*([^\"]*)\"", 1))),
        rule((F.col("n") == "Cargo.toml") & F.col("head").rlike(r"dependencies$"), "cargo", ex(toml, 1), F.concat(ex(toml, 2), ex(toml, 3)), F.col("head").startswith("dev-")),
        rule((F.col("n") == "go.mod") & F.col("line").rlike(r"^\s*(?:require\s+)?[\w./-]+\.[\w./-]+\s+v\d"), "go", ex(r"^\s*(?:require\s+)?([\w./-]+)\s+v", 1), ex(r"\s(v\S+)", 1)),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("path", "ecosystem", "name").agg(F.min(F.struct("is_dev", "version")).alias("m")).select("path", "ecosystem", "name", F.col("m.version").alias("version"), F.col("m.is_dev").alias("is_dev"))


def settings(files: DataFrame) -> DataFrame:
    """(path, name, has_default, description) of .env files; a comment right above describes a setting."""
    from pyspark.sql import Window

    l = files.where(base_name("path").rlike(r"^\.env")).select("path", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line"))  # noqa: E741
    above = F.lag("line").over(Window.partitionBy("path").orderBy("i"))
    name = F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", 1)
    return l.withColumn("above", above).withColumn("name", name).where("name <> ''").select(
        "path", "name", (F.trim(F.regexp_extract("line", r"=(.*)$", 1)) != "").alias("has_default"), F.when(F.col("above").rlike(r"^\s*#"), F.trim(F.regexp_replace("above", r"^\s*#+", ""))).alias("description")
    )


# -- graphs as text ------------------------------------------------------------------------------------------------


def mermaid(links: DataFrame, importance: DataFrame, top: int = 30) -> DataFrame:
    """(text): the links among the top nodes (id, score) as one Mermaid graph; the size is bounded by top."""
    best = importance.orderBy(F.desc("score"), "id").limit(top).select("id")
    inner = links.join(best.withColumnRenamed("id", "source"), "source", "left_semi").join(best.withColumnRenamed("id", "target"), "target", "left_semi")
    line = F.concat(F.lit('  "'), "source", F.lit('" --> "'), "target", F.lit('"'))
    return inner.select(line.alias("l")).distinct().agg(F.concat_ws("\n", F.lit("graph LR"), F.array_join(F.sort_array(F.collect_list("l")), "\n")).alias("text"))


def dot_lines(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(line): node and link lines of a DOT graph, one row each, so that a sink writes them in parallel."""
    colour = F.when(F.col("rank") > 0.5, "red").otherwise("black")
    nodes = ranks.select(F.concat(F.lit('"'), "id", F.lit('" [color='), colour, F.lit("];")).alias("line"))
    return nodes.unionByName(links.select(F.concat(F.lit('"'), "source", F.lit('" -> "'), "target", F.lit('";')).alias("line")))


def symbol_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(document, symbol, role, n): definitions and the places that refer to them, per file, each once."""
    d = nodes.where("is_external = 0").select(F.col("file_path").alias("document"), F.col("id").alias("symbol"), F.lit("definition").alias("role"), F.lit(1).cast("long").alias("n")).distinct()
    r = edges.where("caller_file is not null and callee_id is not null").select("edge_id", F.col("caller_file").alias("document"), F.col("callee_id").alias("symbol")).distinct()
    return d.unionByName(r.groupBy("document", "symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("reference")))


