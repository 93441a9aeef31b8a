"""Lexical source rules: call sites matched against a rule table.

Each text is prepared in place (comments blanked, call sites marked with their line
and column), its call sites are extracted as rows, and the rows meet the rule table
in a broadcast join. The rule table is data; other tables can be passed in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions import text
from cairnlens.functions.keyed import first_per_key, spread

# --- fixed values: rules as (language, module, name, test, argument, rule, CWE, severity)
C_ANY = [
    ("gets", "cwe-242-gets", "CWE-242", "HIGH"),
    ("strcpy", "cwe-120-bounds", "CWE-120", "HIGH"),
    ("strcat", "cwe-120-bounds", "CWE-120", "HIGH"),
    ("sprintf", "cwe-120-bounds", "CWE-120", "HIGH"),
    ("vsprintf", "cwe-120-bounds", "CWE-120", "HIGH"),
    ("tmpnam", "cwe-377-temp-file", "CWE-377", "MEDIUM"),
    ("tmpnam_r", "cwe-377-temp-file", "CWE-377", "MEDIUM"),
    ("tempnam", "cwe-377-temp-file", "CWE-377", "MEDIUM"),
    ("mktemp", "cwe-377-temp-file", "CWE-377", "MEDIUM"),
    ("tmpfile", "cwe-377-temp-file", "CWE-377", "MEDIUM"),
    ("#weak_hash", "cwe-327-328-weak-crypto", "CWE-328", "MEDIUM"),
    ("#weak_cipher", "cwe-327-328-weak-crypto", "CWE-327", "MEDIUM"),
]
C_SCAN = [
    ("scanf", 0), ("vscanf", 0), ("wscanf", 0), ("fscanf", 1), ("sscanf", 1), ("vfscanf", 1),
    ("vsscanf", 1), ("fwscanf", 1), ("swscanf", 1),
]
C_FORMAT = [
    ("printf", 0), ("vprintf", 0), ("wprintf", 0), ("vwprintf", 0), ("fprintf", 1),
    ("vfprintf", 1), ("dprintf", 1), ("vdprintf", 1), ("sprintf", 1), ("vsprintf", 1),
    ("fwprintf", 1), ("vfwprintf", 1), ("syslog", 1), ("vsyslog", 1), ("snprintf", 2),
    ("vsnprintf", 2), ("swprintf", 2), ("vswprintf", 2),
]
C_MODE = [("chmod", 1), ("fchmod", 1), ("creat", 1), ("mkdir", 1), ("open", 2), ("openat", 3)]
PYTHON_SHELL = ["system", "popen", "call", "check_call", "check_output", "run"]
RULES = (
    [("c", "", n, "any", 0, rule, cwe, sev) for n, rule, cwe, sev in C_ANY]
    + [("c", "", n, "open_scan", at, "cwe-120-bounds", "CWE-120", "HIGH") for n, at in C_SCAN]
    + [("c", "", n, "not_literal", at, "cwe-134-format", "CWE-134", "HIGH") for n, at in C_FORMAT]
    + [("c", "", n, "not_literal", 0, "cwe-78-command", "CWE-78", "HIGH")
       for n in ("system", "popen")]
    + [("c", "", n, "other_write", at, "cwe-732-permissions", "CWE-732", "MEDIUM")
       for n, at in C_MODE]
    + [
        ("java", "MessageDigest", "getInstance", "weak_digest", 0, "java-weak-message-digest",
         "CWE-328", "MEDIUM"),
        ("java", "Cipher", "getInstance", "weak_cipher", 0, "java-weak-cipher", "CWE-327",
         "MEDIUM"),
        ("java", "SSLContext", "getInstance", "legacy_tls", 0, "java-legacy-tls", "CWE-326",
         "MEDIUM"),
        ("java", "", "setFeature", "entity_feature", 0, "java-xxe-enabled", "CWE-611", "HIGH"),
        ("java", "", "setExpandEntityReferences", "true", 0, "java-xxe-enabled", "CWE-611", "HIGH"),
        ("java", "", "setXIncludeAware", "true", 0, "java-xxe-enabled", "CWE-611", "HIGH"),
        ("java", "", "setSecure", "false", 0, "java-insecure-cookie", "CWE-614", "MEDIUM"),
        ("java", "PosixFilePermissions", "fromString", "posix_mode", 0,
         "java-overly-permissive-file", "CWE-732", "MEDIUM"),
        ("python", "", "exec", "any", 0, "python-dynamic-code-execution", "CWE-95", "HIGH"),
        ("python", "", "eval", "any", 0, "python-dynamic-code-execution", "CWE-95", "HIGH"),
        ("python", "hashlib", "md5", "any", 0, "python-weak-message-digest", "CWE-328", "MEDIUM"),
        ("python", "hashlib", "sha1", "any", 0, "python-weak-message-digest", "CWE-328", "MEDIUM"),
        ("python", "pickle", "loads", "any", 0, "python-unsafe-deserialization", "CWE-502", "HIGH"),
        ("python", "yaml", "loads", "any", 0, "python-unsafe-deserialization", "CWE-502", "HIGH"),
        ("python", "pickle", "load", "any", 0, "python-unsafe-deserialization", "CWE-502", "HIGH"),
        ("python", "requests", "get", "verify_off", 0, "python-insecure-request", "CWE-295",
         "MEDIUM"),
        ("python", "subprocess", "Popen", "shell_on", 0, "python-command-injection", "CWE-78",
         "HIGH"),
        ("python", "subprocess", "check_shell", "shell_on", 0, "python-command-injection",
         "CWE-78", "HIGH"),
    ]
    + [("python", module, n, "any", 0, "python-command-injection", "CWE-78", "HIGH")
       for module in ("os", "subprocess") for n in PYTHON_SHELL]
)
RULE_COLUMNS = "language, module, name, test, argument, rule_id, cwe, severity"
PYTHON_IMPORTS = ["pickle", "shelve"]
C_WEAK_NAMES = r"\w*(?:md5|sha1)\w*|sha|sha_\w*|des_\w*|rc4\w*|\w*evp_(?:des|rc4)\w*|crypt|ecb_encrypt"
C_WEAK_HASH = r"md5|sha1|^sha$|^sha_"
C_WEAK_CIPHER = r"^des_|^rc4|evp_des|evp_rc4|^crypt$|^ecb_encrypt$"
WEAK_DIGESTS = ["MD2", "MD4", "MD5", "SHA1"]
WEAK_PRIMITIVES = ["DES", "DESEDE", "TRIPLEDES", "RC2", "RC4", "ARCFOUR"]
LEGACY_PROTOCOLS = ["SSL", "SSLV2", "SSLV3", "TLSV1", "TLSV1.0", "TLSV1.1"]
ENTITY_FEATURES = [
    "http://xml.org/sax/features/external-general-entities",
    "http://xml.org/sax/features/external-parameter-entities",
    "http://apache.org/xml/features/nonvalidating/load-external-dtd",
]
DOCTYPE_FEATURES = ["http://apache.org/xml/features/disallow-doctype-decl"]
OPEN_SCAN = r"(?:^|[^%])(?:%%)*%\*?[hljztL]*s"
# --- end of fixed values

DOUBLE = r'"(?:[^"\\\n]|\\.)*+"'
SINGLE = r"'(?:[^'\\\n]|\\.)*+'"
TRIPLE = r'"""(?s:.*?)"""|' + r"'''(?s:.*?)'''"
C_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
MARK_START, MARK_END = "\x01", "\x02"


@dataclass(frozen=True)
class Dialect:
    """Token patterns of a language; an empty one means the language has no such token."""

    comment: str
    string: str
    qualified: bool = False
    ignore_case: bool = False


DIALECTS = {
    "c": Dialect(C_COMMENT, f"{DOUBLE}|{SINGLE}", ignore_case=True),
    "java": Dialect(C_COMMENT, f"{DOUBLE}|{SINGLE}", qualified=True),
    "python": Dialect(r"#[^\n]*", f"{TRIPLE}|{DOUBLE}|{SINGLE}", qualified=True),
    "html": Dialect("", ""),
}


def rule_table(spark: SparkSession, rows=RULES) -> DataFrame:
    return vocab.frame(spark, rows, RULE_COLUMNS)


def blank_comments(source: Column, dialect: Dialect) -> Column:
    """Comments become spaces; every other character keeps its place."""
    if not dialect.comment:
        return source
    token = f"{dialect.string}|{dialect.comment}" if dialect.string else dialect.comment
    kept = F.split(source, token)
    tokens = F.regexp_extract_all(source, F.lit(f"({token})"), 1)
    starts = r"^#" if dialect.comment.startswith("#") else r"^/[/*]"
    blanked = F.transform(
        tokens,
        lambda t: F.when(F.rlike(t, F.lit(starts)), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t),
    )
    pieces = F.zip_with(kept, blanked, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.rlike(source, F.lit(dialect.comment)), F.array_join(pieces, "")).otherwise(source)


def _names_pattern(names: list[str], language: str) -> str:
    plain = sorted(re.escape(name) for name in names if not name.startswith("#"))
    if language == "c" and any(name.startswith("#") for name in names):
        plain.append(C_WEAK_NAMES)
    return "|".join(plain)


def marked_calls(source: Column, names: str, dialect: Dialect) -> Column:
    """The text with ``line:column`` put between each listed name and its parenthesis."""
    flag = "(?i)" if dialect.ignore_case else ""
    head = rf"{flag}(?<![\w$])(?:{names})\s*(?=\()"

    def mark_line(line: Column, number: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(f"({head})"), 1)
        gaps = F.split(line, head)
        # pieces are listed and joined at the end, so a long line is written once
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("column"))

        def step(state: Column, piece: Column) -> Column:
            gap, name = piece["0"], piece["1"]
            at = state["column"] + F.char_length(gap)
            mark = F.concat(
                F.lit(MARK_START), number.cast("string"), F.lit(":"), at.cast("string"),
                F.lit(MARK_END),
            )
            own = F.when(name.isNull(), F.array(gap)).otherwise(F.array(gap, name, mark))
            return F.struct(
                F.concat(state["out"], own).alias("out"),
                (at + F.coalesce(F.char_length(name), F.lit(0))).alias("column"),
            )

        joined = F.aggregate(F.arrays_zip(gaps, found), start, step, lambda s: F.array_join(s["out"], ""))
        return F.when(F.rlike(line, F.lit(head)), joined).otherwise(line)

    lines = F.transform(F.split(source, "\n"), lambda line, i: mark_line(line, i + 1))
    return F.when(F.rlike(source, F.lit(head)), F.array_join(lines, "\n")).otherwise(F.lit(""))


def _balanced(string: str, depth: int = 12) -> str:
    """Text with parentheses nested up to ``depth``: the usual case, in one pattern."""
    inner = rf"(?:[^()\"']++|{string}|[\"'])*+" if string else r"[^()]*+"
    for _ in range(depth):
        plain = rf"[^()\"']++|{string}|[\"']" if string else r"[^()]++"
        inner = rf"(?:{plain}|\({inner}\))*+"
    return inner


def _pieces(value: Column, string: str, marks: str) -> Column:
    """The text as string literals, single marks and runs of anything else."""
    other = rf"""[^{marks}"']+|["']""" if string else rf"[^{marks}]+"
    literal = f"{string}|" if string else ""
    return F.regexp_extract_all(value, F.lit(rf"({literal}[{marks}]|{other})"), 1)


def _deeper(depth: Column, piece: Column) -> Column:
    return depth + F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)


def _until_closed(rest: Column, string: str) -> Column:
    """What stands before the parenthesis that closes one opened before ``rest``,
    however deep it nests; empty if none does."""

    def step(state: Column, piece: Column) -> Column:
        depth = F.when(state["depth"] > 0, _deeper(state["depth"], piece)).otherwise(0)
        return F.struct(
            depth.alias("depth"),
            F.when(depth > 0, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        _pieces(rest, string, "()"), start, step,
        lambda s: F.when(s["depth"] == 0, F.array_join(s["out"], "")).otherwise(""),
    )


def call_sites(files: DataFrame, language: str, names: list[str]) -> DataFrame:
    """One row per call of a listed name outside comments and strings."""
    dialect = DIALECTS[language]
    pattern = _names_pattern(names, language)
    flag = "(?i)" if dialect.ignore_case else ""
    owner = r"(?:(\w+)\s*\.\s*)?" if dialect.qualified else "()"
    mark = rf"{MARK_START}\d+:\d+{MARK_END}"
    head = rf"(?:\w+\s*\.\s*)?(?:{pattern})\s*{mark}" if dialect.qualified else rf"(?:{pattern})\s*{mark}"
    body = _balanced(dialect.string)
    site = rf"(?<![\w$])(?=({head}\({body}\)|{head}\((?s:.*)))(?:{head})"
    token = f"{flag}{dialect.string}|{site}" if dialect.string else f"{flag}{site}"
    clean = files.filter(F.col("language") == language).withColumn(
        "_clean", blank_comments(F.col("text"), dialect)
    )
    marked = clean.withColumn("_marked", marked_calls(F.col("_clean"), pattern, dialect))
    # the lines are a column of their own, so a text is split once for all its sites
    sites = marked.select(
        "file_id", "language", "logical_path", line_index(F.col("text")).alias("_lines"),
        F.filter(
            F.regexp_extract_all("_marked", F.lit(token), 1), lambda s: s != ""
        ).alias("_sites"),
    )
    lines = F.col("_lines")
    numbered = F.transform(
        "_sites",
        lambda s: F.struct(
            s.alias("site"),
            F.regexp_extract(s, rf"{MARK_START}(\d+):", 1).cast("int").alias("line"),
        ),
    )
    with_context = F.transform(
        numbered,
        lambda n: F.struct(
            n["site"].alias("site"), n["line"].alias("start_line"),
            snippet(lines, n["line"]).alias("snippet"),
        ),
    )
    rows = sites.select("file_id", "language", "logical_path", F.inline(with_context))
    site_column = F.col("site")
    # a site that nests deeper than the pattern holds the rest of the text, which is
    # walked with a depth counter
    usual = F.rlike(site_column, F.lit(rf"{flag}^{head}\({body}\)$"))
    rest = F.regexp_extract(site_column, rf"(?s){flag}^{head}\((.*)$", 1)
    arguments = F.regexp_replace(
        F.when(usual, F.regexp_extract(site_column, rf"(?s){MARK_END}\((.*)\)$", 1))
        .otherwise(_until_closed(rest, dialect.string)),
        mark, "",
    )
    return rows.select(
        "file_id",
        "language",
        "logical_path",
        F.regexp_extract(site_column, rf"{flag}^{owner}({pattern})\s*{MARK_START}", 1).alias("module"),
        F.regexp_extract(site_column, rf"{flag}^{owner}({pattern})\s*{MARK_START}", 2).alias("call"),
        "start_line",
        F.regexp_extract(site_column, rf"{MARK_START}\d+:(\d+){MARK_END}", 1).cast("int").alias(
            "start_column"
        ),
        arguments.alias("arguments"),
        "snippet",
    )


def line_index(source: Column) -> Column:
    """The lines of a text with what snippets ask of them: ``size`` in bytes and ``head``,
    the beginning that a snippet can show. Lines that fit are whole in it."""
    return F.transform(F.split(source, "\n"), lambda line: F.struct(
        F.octet_length(line).alias("size"), F.substring(line, 1, vocab.SNIPPET_BYTES).alias("head")
    ))


def snippet(
    lines: Column, line: Column, context: int = vocab.SNIPPET_CONTEXT_LINES,
    maximum: int = vocab.SNIPPET_BYTES,
) -> Column:
    """The hit line with as many lines around it as fit, from a ``line_index``.

    Lines are given up one by one from the longer side, the following ones first.
    Windows are weighed by the sizes of their lines; only the one that fits is put
    together, of lines that are then no longer than it.
    """
    windows = []
    before = after = context
    while before or after:
        windows.append((before, after))
        if after >= before:
            after -= 1
        else:
            before -= 1
    windows.append((0, 0))

    def taken(window) -> Column:
        first = F.greatest(line - window[0], F.lit(1))
        return F.slice(lines, first, line + window[1] - first + 1)

    def joined(window) -> Column:
        return F.array_join(F.transform(taken(window), lambda x: x["head"]), "\n")

    def size(window) -> Column:
        return F.aggregate(taken(window), F.lit(-1), lambda total, x: total + x["size"] + 1)

    fits = [F.when(size(w) <= maximum, joined(w)) for w in windows]
    return F.coalesce(*fits, text.cut_bytes(joined((0, 0)), maximum))


def _argument_list(string: str) -> Column:
    """Arguments between the commas outside any parentheses, of any depth."""

    def step(state: Column, piece: Column) -> Column:
        ends = (piece == ",") & (state["depth"] == 0)
        return F.struct(
            _deeper(state["depth"], piece).alias("depth"),
            F.when(ends, "").otherwise(F.concat(state["current"], piece)).alias("current"),
            F.when(ends, F.concat(state["done"], F.array(state["current"])))
            .otherwise(state["done"]).alias("done"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("current"),
        F.array().cast("array<string>").alias("done"),
    )
    parts = F.aggregate(
        _pieces(F.col("arguments"), string, "(),"), start, step,
        lambda s: F.concat(s["done"], F.array(s["current"])),
    )
    return F.transform(F.filter(parts, lambda a: a != ""), lambda a: text.trim_space(a))


def _literal(argument: Column) -> Column:
    """Content of a string literal argument, null for anything else."""
    bare = F.regexp_replace(argument, r"^\(+\s*|\s*\)+$", "")
    one = r'(?:L|u8|u|U)?"(?:[^"\\\n]|\\.)*+"'
    parts = F.regexp_extract_all(bare, F.lit(r'"((?:[^"\\\n]|\\.)*+)"'), 1)
    return F.when(F.rlike(bare, F.lit(rf"^{one}(?:\s*{one})*$")), F.array_join(parts, ""))


def _other_write(argument: Column) -> Column:
    """A constant mode whose bit for writing by others is set."""
    number = F.regexp_replace(argument, r"(?i)[ul]+$", "")
    octal = F.when(F.rlike(number, F.lit(r"^0[0-7]+$")), F.conv(number, 8, 10))
    hexadecimal = F.when(
        F.rlike(number, F.lit(r"^0[xX][0-9A-Fa-f]+$")), F.conv(F.substr(number, F.lit(3)), 16, 10)
    )
    plain = F.when(F.rlike(number, F.lit(r"^(?:0|[1-9][0-9]*)$")), number)
    value = F.coalesce(octal, hexadecimal, plain).try_cast("bigint")
    return F.coalesce(value.bitwiseAND(F.lit(2)) != 0, F.lit(False))


def _rule_holds() -> Column:
    test = F.col("test")
    argument = F.get("_args", F.col("argument"))
    literal = _literal(argument)
    algorithm = F.replace(F.upper(text.trim_space(literal)), F.lit("-"), F.lit(""))
    feature, flag = F.lower(_literal(F.get("_args", F.lit(0)))), F.get("_args", F.lit(1))
    cipher = (
        F.substring_index(algorithm, "/", 1).isin(WEAK_PRIMITIVES)
        | F.contains(algorithm, F.lit("/ECB/"))
        | F.endswith(algorithm, F.lit("/ECB"))
    )
    keyword = lambda name, value: F.exists(
        "_args", lambda a: F.rlike(a, F.lit(rf"^{name}\s*=\s*{value}$"))
    )
    holds = (
        F.when(test == "any", True)
        .when(test == "not_literal", argument.isNotNull() & literal.isNull())
        .when(test == "open_scan", F.rlike(literal, F.lit(OPEN_SCAN)))
        .when(test == "other_write", _other_write(argument))
        .when(test == "weak_digest", algorithm.isin(WEAK_DIGESTS))
        .when(test == "weak_cipher", cipher)
        .when(test == "legacy_tls", algorithm.isin(LEGACY_PROTOCOLS))
        .when(
            test == "entity_feature",
            (feature.isin(ENTITY_FEATURES) & (flag == "true"))
            | (feature.isin(DOCTYPE_FEATURES) & (flag == "false")),
        )
        .when(test == "true", argument == "true")
        .when(test == "false", argument == "false")
        .when(test == "posix_mode", F.rlike(literal, F.lit(r"^.{7}(?:w.|.x)$")))
        .when(test == "verify_off", keyword("verify", "False"))
        .when(test == "shell_on", keyword("shell", "True"))
    )
    return F.coalesce(holds, F.lit(False))


def _call_keys(language: str) -> Column:
    """Names under which a call is looked up in the rule table."""
    if language != "c":
        return F.array("call")
    low = F.lower("call")
    return F.array_compact(
        F.array(
            low,
            F.when(F.rlike(low, F.lit(C_WEAK_HASH)), "#weak_hash")
            .when(F.rlike(low, F.lit(C_WEAK_CIPHER)), "#weak_cipher"),
        )
    )


FINDING_COLUMNS = [
    "file_id", "language", "logical_path", "rule_id", "cwe", "severity", "call", "start_line",
    "start_column", "snippet",
]


def _call_findings(files: DataFrame, language: str, rows) -> DataFrame:
    own = [row for row in rows if row[0] == language]
    rules = rule_table(files.sparkSession, own).withColumnRenamed("module", "rule_module").drop(
        "language"
    )
    string = DIALECTS[language].string or DOUBLE
    calls = call_sites(files, language, sorted({row[2] for row in own})).withColumn(
        "name", F.explode(_call_keys(language))
    )
    matched = calls.join(rules, "name").filter(
        (F.col("rule_module") == "") | (F.col("rule_module") == F.col("module"))
    )
    return (
        matched.withColumn("_args", _argument_list(string))
        .filter(_rule_holds())
        .select(*FINDING_COLUMNS)
    )


def _import_findings(files: DataFrame) -> DataFrame:
    """Python imports of modules that unpickle data, one finding per imported module."""
    names = "|".join(PYTHON_IMPORTS)
    python = files.filter(F.col("language") == "python")
    split = python.select(
        "file_id", "language", "logical_path", line_index(F.col("text")).alias("_lines"),
        F.split(blank_comments(F.col("text"), DIALECTS["python"]), "\n").alias("_code"),
    )
    lines = F.col("_lines")
    hits = F.filter(
        F.transform(
            F.col("_code"),
            lambda line, i: F.struct(
                (i + 1).alias("start_line"),
                F.when(
                    F.rlike(line, F.lit(r"^\s*import\s")),
                    F.regexp_extract_all(
                        line, F.lit(rf"(?:import\s+|,\s*)({names})(?=\.|\s|,|;|$)"), 1
                    ),
                ).otherwise(
                    F.regexp_extract_all(line, F.lit(rf"^\s*from\s+({names})(?:\.[\w.]+)?\s+import\b"), 1)
                ).alias("modules"),
            ),
        ),
        lambda hit: F.size(hit["modules"]) > 0,
    )
    rows = split.select(
        "file_id", "language", "logical_path",
        F.inline(F.transform(hits, lambda h: F.struct(
            h["start_line"].alias("start_line"), h["modules"].alias("modules"),
            snippet(lines, h["start_line"]).alias("snippet"),
        ))),
    )
    return rows.select(
        "file_id", "language", "logical_path",
        F.lit("python-unsafe-deserialization").alias("rule_id"), F.lit("CWE-502").alias("cwe"),
        F.lit("HIGH").alias("severity"), F.explode("modules").alias("call"), "start_line",
        F.lit(1).alias("start_column"), "snippet",
    )


def source_rule_scan(files: DataFrame, rows=RULES) -> DataFrame:
    """Findings of all languages that the rule rows name.

    ``files`` holds (file_id, language, logical_path, text). C and Java report one
    finding per rule and start position; Python reports every call.
    """
    languages = sorted({row[0] for row in rows})
    files = spread(files.select("file_id", "language", "logical_path", "text"))
    parts = []
    for language in languages:
        found = _call_findings(files, language, rows)
        if language in ("c", "java"):
            found = first_per_key(
                found, ["file_id", "rule_id", "start_line", "start_column"], [F.col("cwe")]
            )
        parts.append(found)
        if language == "python":
            parts.append(_import_findings(files))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def line_of_offset(source: str, offset: str) -> Column:
    """1-based line of a character offset."""
    return text.newline_count(F.substr(F.col(source), F.lit(1), F.col(offset))) + 1


def column_of_offset(source: str, offset: str) -> Column:
    """1-based column of a character offset within its line."""
    return F.char_length(F.substring_index(F.substr(F.col(source), F.lit(1), F.col(offset)), "\n", -1))


def canonical_line(function_start: str, local_line: str) -> Column:
    """Line in the whole source of a line counted from the start of its function."""
    return F.col(function_start) + F.col(local_line) - 1
