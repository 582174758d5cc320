"""What is read off files, functions and documents for people: domains, layers, classes of calls, ratings, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.text import base_name, path_flags
from strandwork.operators.ordered import rank_within

# -- files ---------------------------------------------------------------------------------------------------------

# Folders that name no domain.
NO_DOMAIN = ("src", "lib", "app", "core", "common", "shared", "utils", "helpers", "config")
# What a folder is called as a domain; src, lib and app are passed over.
DOMAIN_NAMES = [
    (r"^(?:api|routes|endpoints?)$", "api"), (r"^(?:models?|entities|schemas?)$", "domain"), (r"^services?$", "services"), (r"^controllers?$", "controllers"), (r"^(?:utils?|helpers?|common)$", "utilities"),
    (r"^components?$", "components"), (r"^hooks?$", "hooks"), (r"^(?:auth|authentication)$", "authentication"), (r"^users?$", "users"), (r"^products?$", "products"), (r"^orders?$", "orders"), (r"^payments?$", "payments"), (r"^core$", "core"),
]
# Layers by path, the first that fits.
LAYER_RULES = [
    ("presentation", r"(?i)/(?:components?|views?|pages?|ui|screens?|layouts?)/|\.(?:jsx|tsx|vue)$|\.component\.|\.page\."),
    ("business", r"(?i)/(?:services?|domain|business|core|logic|usecases?)/|\.service\.|\.usecase\."),
    ("data", r"(?i)/(?:models?|entities?|repositories?|schemas?|db|database|data)/|\.model\."),
]


def path_domain(path: Column) -> Column:
    """The first folder or name of a path that can be a domain, in lower case."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: (p != "") & ~p.isin(*NO_DOMAIN) & ~p.startswith("."))
    return F.try_element_at(parts, F.lit(1))


def folder_domain(folder: Column) -> Column:
    """What a folder is called as a domain: its last segment that says something, by DOMAIN_NAMES or as it is."""
    parts = F.filter(F.split(F.lower(folder), "/"), lambda p: (p != "") & ~p.isin("src", "lib", "app"))
    last = F.try_element_at(parts, F.lit(-1))
    out = F.regexp_replace(last, "[^a-z0-9]", "-")
    for pattern, name in reversed(DOMAIN_NAMES):
        out = F.when(last.rlike(pattern), name).otherwise(out)
    return out


def layer_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LAYER_RULES):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def inferred_domains(files: DataFrame) -> DataFrame:
    """(domain, file_path): files by path_domain, and by the part of their name before a sign where no folder is called so;
    domains of two files or more, tests and configuration aside. files (file_path)."""
    flags = path_flags("file_path")
    f = files.select("file_path").distinct().where(~flags["is_test"] & ~flags["is_config"])
    by_path = f.select(path_domain(F.col("file_path")).alias("domain"), "file_path").where("domain is not null")
    stem = F.regexp_replace(base_name("file_path"), r"\.[^.]+$", "")
    prefix = F.lower(F.split(stem, "[-_.]")[0])
    named = f.where(stem.rlike("[-_.]")).select(prefix.alias("domain"), "file_path").where((F.length("domain") > 2) & ~F.col("domain").isin(*NO_DOMAIN))
    named = named.join(by_path.select("domain").distinct(), "domain", "left_anti")
    every = by_path.unionByName(named)
    return every.join(every.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("domain"), "domain", "left_semi")


def known_domains(files: DataFrame, domains: DataFrame) -> DataFrame:
    """(file_path, domain): the longest of the known domains (domain) that is a segment of a path or begins its file's name
    before a sign; the smallest of several. One row for each file that has one.

    Segments and beginnings of names are joined with the domains, so no file meets a domain it has nothing to do with.
    """
    f = files.select("file_path").where("file_path is not null").distinct()
    low = F.split(F.lower("file_path"), "/")
    stem = F.regexp_replace(F.element_at(low, -1), r"\.[^.]+$", "")
    pieces = F.split(stem, "(?=[-_.])")
    begins = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), ""))
    keys = f.select("file_path", F.explode(F.array_distinct(F.concat(low, begins))).alias("k"))
    d = domains.select("domain").distinct().select("domain", F.lower("domain").alias("k"))
    hit = keys.join(d, "k").groupBy("file_path").agg(F.min(F.struct((-F.length("k")).alias("n"), "domain")).alias("m"))
    return hit.select("file_path", F.col("m.domain").alias("domain"))


def architecture_pattern(files: DataFrame) -> DataFrame:
    """(pattern): microservices, modular, layered, monolith (under 50 files) or unknown, from folders and manifests."""
    f = files.select("file_path").where("file_path is not null").distinct()
    folder = F.lower(F.regexp_extract("file_path", "([^/]*)/[^/]*$", 1))
    layered = [F.max(folder.contains(x).cast("int")) for x in ("controllers", "services", "repositories", "routes", "models", "views")]
    a = f.agg(
        F.count(F.lit(1)).alias("n"), sum(F.coalesce(x, F.lit(0)) for x in layered).alias("layered"), F.max(folder.isin("modules", "features", "domains")).alias("modular"),
        F.sum((base_name("file_path") == "package.json").cast("int")).alias("packages"), F.max(base_name("file_path").contains("docker-compose")).alias("compose"),
    )
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return a.select(
        F.when((F.col("packages") > 1) & no("compose"), "microservices").when(no("modular"), "modular").when(F.col("layered") >= 3, "layered").when(F.col("n") < 50, "monolith").otherwise("unknown").alias("pattern")
    )


def verification_candidates(files: DataFrame, degrees: DataFrame, per_domain: int = 3, least: int = 50, most: int = 500) -> DataFrame:
    """(domain, file_path, connectivity, rank): per domain the best linked source files of a middling number of lines.

    files (file_path, lines), degrees (file, in_degree, out_degree); tests, generated files and files of no domain aside.
    """
    flags = path_flags("file_path")
    f = files.select("file_path", "lines").distinct().where(F.col("lines").between(least, most) & ~flags["is_test"] & ~flags["is_generated"])
    f = f.where(F.col("file_path").rlike(r"(?i)\.(?:ts|tsx|js|jsx|py|go|rs|rb|java|cpp|c|cs|swift|kt)$"))
    d = degrees.select(F.col("file").alias("file_path"), (F.col("in_degree") + F.col("out_degree")).alias("connectivity"))
    f = f.join(d, "file_path", "left").withColumn("connectivity", F.coalesce("connectivity", F.lit(0))).withColumn("domain", path_domain(F.col("file_path"))).where("domain is not null")
    r = rank_within(f, ["domain"], [F.desc("connectivity"), F.asc("file_path")], "rank").where(F.col("rank") <= per_domain)
    return r.select("domain", "file_path", "connectivity", "rank")


# -- functions -----------------------------------------------------------------------------------------------------

# Names of libraries and calls by kind.
EXTERNAL = {
    "http": "fetch axios got superagent node-fetch ky request http https xmlhttprequest grpc undici requests aiohttp httpx urllib urllib2 urllib3 curl curleasy pycurl httpclient httpurlconnection reqwest hyper ureq isahc surf net faraday httparty rest typhoeus excon okhttp retrofit feign resttemplate webclient urlsession alamofire moya".split(),
    "database": "pg mysql mysql2 sqlite sqlite3 redis ioredis mongoose mongo mongodb prisma knex sequelize typeorm drizzle cassandra dynamodb firestore supabase neo4j influxdb clickhouse kysely psycopg2 psycopg sqlalchemy pymysql asyncpg motor aiomysql tortoise sql gorm sqlx pgx bun diesel seaorm rusqlite activerecord sequel jdbc hibernate jpa entitymanager datasource jdbctemplate r2dbc coredata grdb realm".split(),
    "filesystem": "fs fsp readfile writefile readdir stat mkdir unlink rename copyfile createreadstream createwritestream open fopen fread fwrite fclose remove ifstream ofstream fstream os path file".split(),
    "stdlib": (
        "array object string number math json date regexp promise map set weakmap weakset symbol reflect proxy console error buffer process int8array uint8array "
        "sys re io abc ast csv copy enum glob gzip hmac html logging operator pathlib pickle pprint queue random shutil signal socket ssl struct subprocess tempfile threading time traceback typing uuid warnings collections functools itertools contextlib dataclasses unittest hashlib base64 binascii codecs inspect importlib weakref gc platform shlex textwrap "
        "std printf fprintf sprintf snprintf scanf malloc calloc realloc free memcpy memmove memset memcmp strlen strcpy strncpy strcat strcmp strncmp strstr assert abort exit atexit "
        "fmt log sort sync atomic bytes errors context runtime bufio unicode strings strconv rand flag testing vec option result iter thread env cell rc arc mutex rwlock channel mpsc "
        "integer float numeric enumerable comparable kernel module class basicobject nilclass trueclass falseclass range proc method encoding "
        "system long double boolean character list arraylist linkedlist hashmap treemap hashset treeset optional stream arrays objects runnable exception runtimeexception illegalargumentexception stringbuilder stringbuffer scanner "
        "int bool dictionary swift foundation dispatchqueue notificationcenter nsstring nsarray nsdictionary"
    ).split(),
}
NOISE = "response body t err error buf str res req data result".split()


def external_kind(name: Column) -> Column:
    """http, database, filesystem, stdlib or unknown, by the part of a name before its first dot."""
    first = F.lower(F.split_part(name, F.lit("."), F.lit(1)))
    base = F.regexp_replace(first, "[^a-z0-9]", "")
    out = F.when(name.contains(".") & first.isin(*NOISE), "stdlib").otherwise("unknown")
    for kind in reversed(EXTERNAL):
        out = F.when(base.isin(*EXTERNAL[kind]), kind).otherwise(out)
    return out


def refactoring_approach(risk: Column, fan_out: Column, is_hub: Column) -> Column:
    """What to do with a function of a risk: thresholds 20 and 45, hubs that call more than five, callers of more than eight."""
    return (
        F.when(risk <= 20, "refactor freely").when(risk <= 45, "refactor with tests").when(is_hub & (fan_out > 5), "split responsibility")
        .when(is_hub, "introduce facade").when(fan_out > 8, "decompose fan-out").otherwise("incremental extraction")
    )


def risk_badge(risk: Column) -> Column:
    return F.when(risk < 40, "low").when(risk < 70, "medium").when(risk < 85, "high").otherwise("critical")


def search_depth(token_budget: Column) -> Column:
    """How far to look for a budget of tokens, at twenty for a node."""
    n = F.floor(token_budget / 20)
    return F.when(n <= 10, 1).when(n <= 30, 2).otherwise(3)


def is_public(name: Column) -> Column:
    return ~name.startswith("_")


def arity(signature: Column) -> Column:
    """Number of parameters of the first bracket of a signature; null without one. Brackets within are taken out from the
    inside, up to four deep."""
    inside = F.regexp_extract(signature, r"^[^(]*\((.*)$", 1)
    for _ in range(4):
        inside = F.regexp_replace(inside, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", "")
    own = F.split_part(inside, F.lit(")"), F.lit(1))
    parts = F.filter(F.split(own, ","), lambda x: F.trim(x) != "")
    return F.when(signature.contains("("), F.size(parts))


def insertion_reason(name: Column, strategy: Column, fan_in: Column, fan_out: Column) -> Column:
    """One sentence on why a place was chosen."""
    return (
        F.when(strategy == "extend_entry_point", F.concat(name, F.lit(" is an entry point; extend it or put another beside it")))
        .when(strategy == "add_orchestration_step", F.concat(name, F.lit(" runs "), fan_out.cast("string"), F.lit(" calls; add a step")))
        .when(strategy == "cross_cutting_hook", F.concat(name, F.lit(" is called from "), fan_in.cast("string"), F.lit(" places; a hook here reaches all")))
        .when(strategy == "extract_shared_logic", F.concat(name, F.lit(" is little used; shared logic can live here")))
        .otherwise(F.concat(name, F.lit(" is close to the task; call alongside it")))
    )


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """One row: n_functions, n_files, n_modules, avg_fan_out of the internal functions, repeated rows once."""
    n = nodes.where("is_external = 0").select("id", "file_path", "fan_out").distinct()
    module = F.regexp_replace("file_path", "/[^/]*$", "")
    return n.agg(
        F.count_distinct("id").alias("n_functions"), F.count_distinct("file_path").alias("n_files"), F.count_distinct(module).alias("n_modules"), F.round(F.avg("fan_out"), 1).alias("avg_fan_out")
    )


def language_statistics(nodes: DataFrame) -> DataFrame:
    """(language, n_files, n_functions) of the internal functions, languages in lower case, empty ones as 'unknown'."""
    lang = F.when(F.trim(F.coalesce("language", F.lit(""))) == "", "unknown").otherwise(F.lower(F.trim("language")))
    n = nodes.where("is_external = 0").select("id", "file_path", lang.alias("language")).distinct()
    return n.groupBy("language").agg(F.count_distinct("file_path").alias("n_files"), F.count_distinct("id").alias("n_functions"))


# -- documents -----------------------------------------------------------------------------------------------------


def decision_headers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, decision, title, status, domains, layers): records with an ADR heading; status 'accepted' where none is
    named; domains and layers from the lines that list them, null without such a line."""
    pick = lambda p, g=1: F.regexp_extract(text, p, g)
    listed = lambda word: F.when(pick(rf"\*\*{word}\*\*:[ \t]*([^\n]+)") != "", F.filter(F.transform(F.split(pick(rf"\*\*{word}\*\*:[ \t]*([^\n]+)"), ","), lambda x: F.trim(x)), lambda x: x != ""))
    d = docs.where(F.col(text).rlike(r"(?m)^#\s+ADR-\d+:"))
    status = pick(r"## Status\s+(\w+)")
    return d.select(
        doc_id, pick(r"(?m)^#\s+(ADR-\d+):").alias("decision"), F.trim(pick(r"(?md)^#\s+ADR-\d+:[ \t]*(.+)")).alias("title"), F.when(status == "", "accepted").otherwise(F.lower(status)).alias("status"),
        listed("Domains").alias("domains"), listed("Layers").alias("layers"),
    )


def decision_drift(decisions: DataFrame, changed_domains: DataFrame, known: DataFrame, changed_decisions: DataFrame) -> DataFrame:
    """(kind, decision, domain): 'adr_gap' for a decision on a domain that changed while the decision did not, 'adr_orphaned'
    for one on a domain that is not known. decisions (decision, domains), the others (domain), (domain), (decision)."""
    d = decisions.select("decision", F.explode("domains").alias("domain")).distinct()
    gap = d.join(changed_domains.select("domain").distinct(), "domain", "left_semi").join(changed_decisions.select("decision").distinct(), "decision", "left_anti")
    lost = d.join(known.select("domain").distinct(), "domain", "left_anti")
    return gap.select(F.lit("adr_gap").alias("kind"), "decision", "domain").unionByName(lost.select(F.lit("adr_orphaned").alias("kind"), "decision", "domain"))


def section(text: Column, heading: str) -> Column:
    """The first paragraph below a heading of the second level, null without one."""
    found = F.regexp_extract(text, rf"(?md)^##[ \t]+{heading}[ \t]*\r?\n\s*([^\n]+(?:\n(?![ \t]*\r?\n|#)[^\n]+)*)", 1)
    return F.when(found != "", F.trim(found))


def referenced_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, path): the paths with a source file's ending that a text names in back quotes, each once."""
    found = F.regexp_extract_all(text, F.lit(r"`([\w./-]+\.(?:ts|tsx|js|jsx|py|go|java|rs|rb|cpp|swift))`"), 1)
    return docs.where(F.col(text).isNotNull()).select(doc_id, F.explode(found).alias("path")).distinct()
