"""Scalar functions over strings, paths, names and code, all as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits of two characters or more."""
    return F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda x: F.length(x) > 1)


# Scripts written without spaces between words; each of their characters counts as a word.
_NO_SPACES = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def unicode_words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of any script, of one character or more."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(rf"([{_NO_SPACES}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_NO_SPACES}]]+)"), 1)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(\S+)"), 1)


def strip_comments(code: Column | str) -> Column:
    """Without //, #, /* */ and triple-quoted parts, in this order."""
    c = _c(code)
    for pattern in (r"//[^\n]*", r"#[^\n]*", r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''"):
        c = F.regexp_replace(c, pattern, "")
    return c


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def normalise_code(code: Column | str) -> Column:
    """Code without comments, white space as single spaces."""
    return squeeze(strip_comments(code))


# Words that renaming leaves alone.
CODE_WORDS = (
    "if else for while do switch case break continue return function const let var class extends implements interface new this super import "
    "export from default try catch finally throw async await yield typeof instanceof in of void null true false def self lambda with as pass raise "
    "except elif is not and or None True False global nonlocal del assert func package range defer go chan map struct type select fallthrough "
    "public private protected static final abstract int long double float boolean string String char byte short throws enum"
).split()


def rename_identifiers(code: Column | str) -> Column:
    """Every identifier that is no keyword as _v0, _v1 ... in the order of its first place; null stays null.

    In Arrow batches: a fold over a map of names has no built-in form that is not quadratic in the names.
    """
    keep, name = frozenset(CODE_WORDS), re.compile(r"[A-Za-z_$][\w$]*", re.A)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            seen: dict[str, str] = {}
            return name.sub(lambda m: m.group() if m.group() in keep else seen.setdefault(m.group(), f"_v{len(seen)}"), x)

        return s.map(one)

    return run(_c(code))


def sha16(text: Column | str) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def shingles(toks: Column | str, n: int = 5) -> Column:
    """Distinct runs of n tokens, joined by a space; none for fewer tokens."""
    t = _c(toks)
    return F.when(F.size(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two sets; 1 where both are empty."""
    a, b = _c(a), _c(b)
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


DECISIONS = r"\b(?:if|for|while|case|catch|switch)\b|&&|\|\||\?\?|\?(?![.?:])"
DECISIONS_PYTHON = r"\b(?:if|elif|for|while|except|and|or|assert|with)\b"


def cyclomatic_complexity(code: Column | str, language: Column | str) -> Column:
    """One more than the number of decision points."""
    return F.lit(1) + F.when(F.lower(_c(language)) == "python", F.regexp_count(_c(code), F.lit(DECISIONS_PYTHON))).otherwise(F.regexp_count(_c(code), F.lit(DECISIONS)))


def line_of(text: Column | str, offset: Column | str) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(_c(text), F.lit(1), _c(offset)), "\n"))


def count_lines(text: Column | str) -> Column:
    return F.size(F.split(_c(text), "\n"))


# Languages by extension.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "pyi": "Python",
    "go": "Go", "rs": "Rust", "rb": "Ruby", "java": "Java", "kt": "Kotlin", "cs": "C#", "cpp": "C++", "cc": "C++", "hpp": "C++", "h": "C++", "c": "C", "swift": "Swift", "php": "PHP", "json": "JSON",
}


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column | str) -> Column:
    """The language an extension stands for, 'unknown' for any other."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)], F.lit("unknown"))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def directory(path: Column | str) -> Column:
    return F.when(_c(path).contains("/"), F.regexp_replace(_c(path), "/[^/]*$", "")).otherwise("")


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def split_words(name: Column | str) -> Column:
    """The lower-case words of a camelCase, snake_case or kebab-case name."""
    spaced = F.regexp_replace(F.regexp_replace(_c(name), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda x: x != "")


def kebab(name: Column | str) -> Column:
    return F.array_join(split_words(name), "-")


def pascal(name: Column | str) -> Column:
    return F.array_join(F.transform(split_words(name), F.initcap), "")


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def alphanumeric(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", "")


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 for equal names, 0.8 where one holds the other, else 0.7 of the Jaccard share of their words."""
    x, y = alphanumeric(a), alphanumeric(b)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(0.7 * jaccard(split_words(a), split_words(b)))


def normalise_url(url: Column | str) -> Column:
    """Path of a URL with every kind of parameter as :param, no host, query, doubled or closing slash, in lower case."""
    u = F.regexp_replace(_c(url), r"\$\{[^}]*\}", ":param")
    u = F.regexp_replace(u, r"^[a-z]+://[^/]+", "")
    u = F.regexp_replace(u, r"[?#].*$", "")
    u = F.regexp_replace(u, r"\{[^}/]*\}|<[^>/]*>|\[[^\]/]*\]|:[A-Za-z_]\w*", ":param")
    u = F.regexp_replace(F.concat(F.lit("/"), u), "/+", "/")
    return F.lower(F.when(F.length(u) > 1, F.regexp_replace(u, "/$", "")).otherwise(u))


def join_paths(prefix: Column | str, path: Column | str) -> Column:
    """A route's prefix and path with one slash between."""
    a, b = F.regexp_replace(_c(prefix), "/+$", ""), F.regexp_replace(_c(path), "^/+", "")
    both = F.when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))
    return F.when(both == "", "/").otherwise(both)


def estimate_tokens(text: Column | str) -> Column:
    """A quarter token for a letter, half a one for a sign of code, rounded up."""
    signs = F.regexp_count(_c(text), F.lit(r"[{}()\[\];:=<>+\-*/&|!?.,'\"`@#$%^\\~]"))
    return F.ceil((F.length(_c(text)) - signs) / 4 + signs / 2)


def redact(text: Column | str) -> Column:
    """Without what looks like a secret."""
    c = F.regexp_replace(_c(text), r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[:=]\s*)['\"]?[^\s'\"]{6,}['\"]?", "$1[REDACTED]")
    return F.regexp_replace(c, r"\b(?:sk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}", "[REDACTED]")


def module_of(path: Column | str, roots: tuple[str, ...] = ("src", "lib", "packages", "app")) -> Column:
    """The segment behind the first root, null without one."""
    p = F.split(_c(path), "/")
    at = F.array_min(F.filter(F.transform(F.array(*map(F.lit, roots)), lambda r: F.array_position(p, r).cast("int")), lambda i: i > 0))
    return F.when(at < F.size(p) - 1, F.try_element_at(p, at + 1))


# What test, configuration and generated files and entry points are called.
TEST_PATH = r"(?:^|/)(?:tests?|__tests__|specs?)/|\.(?:test|spec)\.[^./]+$|_(?:test|spec)\.[^./]+$|(?:^|/)(?:test|spec)_[^/]*\.[^./]+$"
CONFIG_PATH = r"(?:^|/)\.[^/]*rc(?:\.(?:js|json|ya?ml))?$|(?:config|settings)\.[^/]*$|(?:^|/)tsconfig[^/]*\.json$|(?:^|/)(?:package\.json|pyproject\.toml|Cargo\.toml|go\.mod|Gemfile|composer\.json)$"
GENERATED_PATH = r"\.d\.ts$|\.generated\.(?:ts|js)$|/generated/|/__generated__/"
ENTRY_PATH = r"(?i)(?:^|/)(?:index|main|app|server|cli|entry)(?:\.[^./]*)?$|^(?:src|lib|bin)/[^/]+$"


def path_flags(path: Column | str) -> Column:
    """struct(is_test, is_config, is_generated, is_entry_point)."""
    p = _c(path)
    return F.struct(
        p.rlike(TEST_PATH).alias("is_test"), p.rlike(CONFIG_PATH).alias("is_config"), p.rlike(GENERATED_PATH).alias("is_generated"), p.rlike(ENTRY_PATH).alias("is_entry_point")
    )


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a glob with **, * and ?."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def matches_any(path: Column | str, globs: list[str]) -> Column:
    return _c(path).rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def decision_id(session: Column | str, domain: Column | str, title: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", _c(session), _c(domain), _c(title)), 256), 1, 8)


def remote_to_web(url: Column | str) -> Column:
    """A git remote as an https address."""
    u = F.regexp_replace(_c(url), r"^git@([^:]+):", "https://$1/")
    return F.regexp_replace(F.regexp_replace(u, r"^ssh://(?:[^@/]+@)?", "https://"), r"\.git/?$", "")


LOG_LINE = r"^\s*(?:console\.\w+|logger?\.\w+|log\.\w+|print(?:ln|f)?|fmt\.Print\w*|System\.out\.\w+)\s*\("


def skeleton(code: Column | str) -> Column:
    """Code without comments and log lines, runs of blank lines as one."""
    lines = F.filter(F.split(strip_comments(code), "\n"), lambda x: ~x.rlike(LOG_LINE))
    return F.trim(F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.rtrim(x)), "\n"), "\n{3,}", "\n\n"))


def skeleton_is_worth(code: Column | str, share: float = 0.8) -> Column:
    return F.length(skeleton(code)) < share * F.length(_c(code))
