"""Queries: source rules over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlens.operators import rules
from cairnlens.plans.registry import query

# the texts of source_files hold one call per line, so the check can test whole lines
LINES = """
SELECT f.file_id, f.language, f.logical_path, t.n AS start_line, t.line
FROM source_files f, (SELECT file_id AS id, unnest(string_split(text, chr(10))) AS line,
                             generate_subscripts(string_split(text, chr(10)), 1) AS n
                      FROM source_files) t
WHERE t.id = f.file_id"""
RULE_LINES = [
    ("c", r"^  gets\(s\)", "cwe-242-gets", "CWE-242", "HIGH", "gets"),
    ("c", r"^  strcpy\(", "cwe-120-bounds", "CWE-120", "HIGH", "strcpy"),
    ("c", r"^  printf\(s\)", "cwe-134-format", "CWE-134", "HIGH", "printf"),
    ("c", r"system\(cmd\)", "cwe-78-command", "CWE-78", "HIGH", "system"),
    ("c", r"chmod\(p, 0777\)", "cwe-732-permissions", "CWE-732", "MEDIUM", "chmod"),
    ("c", r"MD5_Init\(", "cwe-327-328-weak-crypto", "CWE-328", "MEDIUM", "MD5_Init"),
    ("c", r"""scanf\("%s""", "cwe-120-bounds", "CWE-120", "HIGH", "scanf"),
    ("c", r"tmpnam\(", "cwe-377-temp-file", "CWE-377", "MEDIUM", "tmpnam"),
    ("java", r"""getInstance\("MD5"\)""", "java-weak-message-digest", "CWE-328", "MEDIUM", "getInstance"),
    ("java", r"ECB", "java-weak-cipher", "CWE-327", "MEDIUM", "getInstance"),
    ("java", r"TLSv1\.1", "java-legacy-tls", "CWE-326", "MEDIUM", "getInstance"),
    ("java", r"setSecure\(false\)", "java-insecure-cookie", "CWE-614", "MEDIUM", "setSecure"),
    ("java", r"setXIncludeAware\(true\)", "java-xxe-enabled", "CWE-611", "HIGH", "setXIncludeAware"),
    ("python", r"^    return eval\(", "python-dynamic-code-execution", "CWE-95", "HIGH", "eval"),
    ("python", r"os\.system\(", "python-command-injection", "CWE-78", "HIGH", "system"),
    ("python", r"hashlib\.md5\(", "python-weak-message-digest", "CWE-328", "MEDIUM", "md5"),
    ("python", r"verify=False", "python-insecure-request", "CWE-295", "MEDIUM", "get"),
    ("python", r"Popen\(x, shell=True", "python-command-injection", "CWE-78", "HIGH", "Popen"),
    ("python", r"^import pickle", "python-unsafe-deserialization", "CWE-502", "HIGH", "pickle"),
    ("python", r"^from shelve", "python-unsafe-deserialization", "CWE-502", "HIGH", "shelve"),
]
EXPECTED = " UNION ALL ".join(
    f"""SELECT file_id, language, '{rule}' AS rule_id, '{cwe}' AS cwe, '{severity}' AS severity,
        '{call}' AS call, start_line FROM ({LINES})
        WHERE language = '{language}' AND regexp_matches(line, '{pattern}')"""
    for language, pattern, rule, cwe, severity, call in RULE_LINES
)


@query("source_rule_scan", EXPECTED)
def _(d):
    return rules.source_rule_scan(d.source_files).select(
        "file_id", "language", "rule_id", "cwe", "severity", "call", "start_line"
    )


def _language(name: str):
    def run(d):
        rows = [row for row in rules.RULES if row[0] == name]
        return rules.source_rule_scan(d.source_files, rows).select(
            "file_id", "rule_id", "cwe", "severity", "start_line"
        )

    return run


for _name in ("c", "java", "python"):
    query(
        f"{_name}_rule_scan",
        f"SELECT file_id, rule_id, cwe, severity, start_line FROM ({EXPECTED}) "
        f"WHERE language = '{_name}'",
    )(_language(_name))


@query("rule_scan_summary", f"""
SELECT language, rule_id, severity, count(*) AS finding_count,
       count(DISTINCT file_id) AS file_count FROM ({EXPECTED}) GROUP BY ALL""")
def _(d):
    return rules.source_rule_scan(d.source_files).groupBy("language", "rule_id", "severity").agg(
        F.count("*").alias("finding_count"), F.count_distinct("file_id").alias("file_count")
    )


@query("snippet", rf"""
SELECT l.file_id, l.start_line, l.rule_id, array_to_string(string_split(f.text, chr(10))[
    greatest(l.start_line - 3, 1):l.start_line + 3], chr(10)) AS snippet
FROM ({EXPECTED}) l JOIN source_files f ON f.file_id = l.file_id""")
def _(d):
    return rules.source_rule_scan(d.source_files).select("file_id", "start_line", "rule_id", "snippet")


PAGE_RULES = [("html", "", "track", "any", 0, "page-track-call", "CWE-359", "LOW")]


@query("page_rule_scan", r"""
SELECT page_id AS file_id, len(regexp_extract_all(html, '\btrack\s*\(')) AS finding_count,
       length(html) - length(replace(html, chr(10), '')) + 1 AS line_count
FROM pages WHERE regexp_matches(html, '\btrack\s*\(')""")
def _(d):
    files = d.pages.select(
        F.col("page_id").alias("file_id"), F.lit("html").alias("language"),
        F.col("url").alias("logical_path"), F.col("html").alias("text"),
    )
    found = rules.source_rule_scan(files, PAGE_RULES).groupBy("file_id").agg(
        F.count("*").alias("finding_count")
    )
    lines = d.pages.select(
        F.col("page_id").alias("file_id"), F.size(F.split("html", "\n")).alias("line_count")
    )
    return found.join(lines, "file_id")


@query("line_of_offset", r"""
WITH found AS (
  SELECT doc_id, text, greatest(length(text) - strpos(reverse(text), 'eht') - 1, 0)
         * sign(strpos(text, 'the'))::INT AS found_at FROM documents
), heads AS (SELECT doc_id, found_at, string_split(left(text, found_at::BIGINT), chr(10)) AS lines FROM found)
SELECT doc_id, found_at::INT AS found_at, CASE WHEN found_at > 0 THEN len(lines) END AS line,
       CASE WHEN found_at > 0 THEN length(lines[-1]) END AS column_number,
       CASE WHEN found_at > 0 THEN len(lines) + doc_id % 50 END AS source_line
FROM heads""")
def _(d):
    # the last hit of each text, so that texts are read to their end; the function that
    # holds it starts at one of fifty lines
    last = F.char_length("text") - F.instr(F.reverse("text"), "eht") - 1
    found = d.documents.select(
        "doc_id", "text", F.when(F.contains("text", F.lit("the")), last).otherwise(0).alias("found_at"),
        (F.col("doc_id") % 50 + 1).alias("function_start"),
    )
    hit = F.col("found_at") > 0
    placed = found.withColumn("line", F.when(hit, rules.line_of_offset("text", "found_at"))).withColumn(
        "column_number", F.when(hit, rules.column_of_offset("text", "found_at"))
    )
    return placed.select(
        "doc_id", "found_at", "line", "column_number",
        F.when(hit, rules.canonical_line("function_start", "line")).alias("source_line"),
    )
