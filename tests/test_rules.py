"""One text with every lexical rule per language, and near misses that must stay silent."""

import pytest

from cairnlens.operators import rules

C_ALL = r'''
void f(char *s, int fd) {
  gets(s);
  strcpy(s, t);
  scanf("%d %s", &n, s);
  fprintf(out, fmt, 1);
  system(command);
  mktemp(path);
  MD5_Update(c, s, n);
  DES_set_key(k, ks);
  chmod(p, 0666);
  openat(d, p, O_CREAT,
         0777);
}
'''
C_MISS = r'''
/* gets(s);
   strcpy(a, b); */
// system(x)
const char *u = "http://x/ gets(s)";
scanf("%10s %%s", s);
fprintf(out, "%d", 1);
printf("a" "b", x);
system("ls");
chmod(p, 0644);
open(p, O_CREAT, mode);
my_gets(s); gets_s(s); x = gets;
'''
JAVA_ALL = '''
class A { void m() {
  MessageDigest.getInstance("SHA-1");
  Cipher.getInstance("DES/CBC/PKCS5Padding");
  SSLContext.getInstance("TLSv1");
  f.setFeature("http://xml.org/sax/features/external-general-entities", true);
  f.setFeature("http://apache.org/xml/features/disallow-doctype-decl", false);
  f.setExpandEntityReferences(true);
  cookie.setSecure(false);
  PosixFilePermissions.fromString("rwxrwxrwx");
} }
'''
JAVA_MISS = '''
  MessageDigest.getInstance("SHA-256"); // MessageDigest.getInstance("MD5")
  String s = "Cipher.getInstance(\\"DES\\")";
  Cipher.getInstance("AES/GCM/NoPadding"); Other.getInstance("MD5");
  SSLContext.getInstance("TLSv1.2"); cookie.setSecure(true);
  f.setFeature("http://apache.org/xml/features/disallow-doctype-decl", true);
  PosixFilePermissions.fromString("rwxr-x---"); MessageDigest.getInstance(name);
'''
PYTHON_ALL = '''
import os, pickle
from shelve import open
exec(code)
os.system(cmd)
subprocess.run(["a"])
hashlib.sha1(b"")
yaml.loads(x)
requests.get(u, verify=False)
subprocess.Popen(
    c, shell=True)
'''
PYTHON_MISS = '''
"""
eval(x)
"""
# import pickle
import pickled
text = 'exec(x)'
my.system(x); hashlib.sha256(b""); json.loads(x)
requests.get(u, verify=True); subprocess.Popen(c, shell=False); run(x); evaluate(x)
'''


def _scan(spark, language, source):
    files = spark.createDataFrame(
        [(1, language, "p", source)], "file_id BIGINT, language STRING, logical_path STRING, text STRING"
    )
    rows = [row for row in rules.RULES if row[0] == language]
    return rules.source_rule_scan(files, rows).orderBy("start_line", "start_column", "cwe").collect()


def test_c(spark):
    found = [(r.start_line, r.cwe) for r in _scan(spark, "c", C_ALL)]
    assert found == [
        (3, "CWE-242"), (4, "CWE-120"), (5, "CWE-120"), (6, "CWE-134"), (7, "CWE-78"),
        (8, "CWE-377"), (9, "CWE-328"), (10, "CWE-327"), (11, "CWE-732"), (12, "CWE-732"),
    ]
    assert _scan(spark, "c", C_MISS) == []


def test_java(spark):
    found = [(r.start_line, r.rule_id) for r in _scan(spark, "java", JAVA_ALL)]
    assert found == [
        (3, "java-weak-message-digest"), (4, "java-weak-cipher"), (5, "java-legacy-tls"),
        (6, "java-xxe-enabled"), (7, "java-xxe-enabled"), (8, "java-xxe-enabled"),
        (9, "java-insecure-cookie"), (10, "java-overly-permissive-file"),
    ]
    assert _scan(spark, "java", JAVA_MISS) == []


def test_python(spark):
    found = [(r.start_line, r.cwe) for r in _scan(spark, "python", PYTHON_ALL)]
    assert found == [
        (2, "CWE-502"), (3, "CWE-502"), (4, "CWE-95"), (5, "CWE-78"), (6, "CWE-78"),
        (7, "CWE-328"), (8, "CWE-502"), (9, "CWE-295"), (10, "CWE-78"),
    ]
    assert _scan(spark, "python", PYTHON_MISS) == []


def test_columns_nested_calls_and_snippet(spark):
    source = "int a;\n  x(strcpy(a, gets(b)));\n" + "y;\n" * 5
    found = _scan(spark, "c", source)
    assert [(r.call, r.start_line, r.start_column) for r in found] == [("strcpy", 2, 5), ("gets", 2, 15)]
    assert found[0].snippet == "int a;\n  x(strcpy(a, gets(b)));\ny;\ny;\ny;"
    wide = "a" * 900 + "\n gets(s);\n" + "b" * 300
    assert _scan(spark, "c", wide)[0].snippet == "a" * 900 + "\n gets(s);"


@pytest.mark.parametrize("argument,expected", [
    ("0777", 1), ("0775", 0), ("0x1FF", 1), ("2", 1), ("MODE", 0), ("02u", 1), ("08", 0),
])
def test_modes(spark, argument, expected):
    assert len(_scan(spark, "c", f"chmod(p, {argument});")) == expected


def test_calls_of_any_nesting_depth(spark):
    deep = lambda x, n: "g(" * n + x + ")" * n
    body = f'void f() {{\n  system({deep("x", 12)});\n  chmod({deep("p", 10)}, 0777);\n  chmod({deep("p", 10)}, 0700);\n  gets(\n'
    files = spark.createDataFrame([(1, "c", "a.c", body)], "file_id INT, language STRING, logical_path STRING, text STRING")
    found = sorted((r.start_line, r.arguments) for r in rules.call_sites(files, "c", ["system", "chmod", "gets"]).collect())
    assert found == [(2, deep("x", 12)), (3, deep("p", 10) + ", 0777"), (4, deep("p", 10) + ", 0700"), (5, "")]
    lines = {r.start_line for r in rules.source_rule_scan(files).collect()}
    assert 2 in lines and 3 in lines and 4 not in lines


def test_long_lines_and_deep_calls_take_time_in_proportion(spark):
    """Ten thousand calls of depth ten in one line of a megabyte."""
    import time

    def seconds(calls):
        deep = "f(" * 9 + "g" + ")" * 9
        text = "".join(f"gets(s{i}, {deep}, 'pad pad pad pad pad pad pad pad pad'); " for i in range(calls)) + "\nend"
        started = time.perf_counter()
        rows = _scan(spark, "c", text)
        return time.perf_counter() - started, rows

    seconds(10)
    few, rows = seconds(2500)
    many, found = seconds(10000)
    assert len(rows) == 2500 and len(found) == 10000
    assert many < 8 * few + 5
    assert {r.start_line for r in found} == {1} and found[0].snippet.startswith("gets(s0")
    assert max(len(r.snippet.encode()) for r in found) <= 1024
    assert len({r.start_column for r in found}) == 10000


def test_snippets_weigh_their_lines(spark):
    lines = ["a" * 10, "é" * 300, "b" * 10, "gets(s);", "c" * 10, "d" * 600, "e" * 10]
    hit, = _scan(spark, "c", "\n".join(lines))
    assert hit.start_line == 4 and hit.snippet == "\n".join(lines[1:5])
    wide = "x" * 2000
    hit, = _scan(spark, "c", f"{wide}\ngets(s); {wide}\n{wide}")
    assert hit.snippet == ("gets(s); " + wide)[:1024]
