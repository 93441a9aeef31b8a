"""Closed vocabularies. All values below are fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: severities, lowest rank first ------------------------------
SEVERITIES = ["UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_DISPLAY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]
RISK_LEVELS = ["UNKNOWN", "NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

# --- fixed values: task life cycle --------------------------------------------
TASK_STATUSES = [
    "UPLOADING", "QUEUED", "VALIDATING", "IDENTIFYING", "EXTRACTING",
    "INDEXING", "SCANNING", "REPORTING", "SUCCEEDED", "PARTIAL_SUCCEEDED",
    "FAILED", "CANCEL_REQUESTED", "CANCELLED", "DELETING", "DELETED",
]
ACTIVE_TASK_STATUSES = [
    "VALIDATING", "IDENTIFYING", "EXTRACTING", "INDEXING",
    "SCANNING", "REPORTING", "CANCEL_REQUESTED", "DELETING",
]
OVERVIEW_ACTIVE_STATUSES = [
    "UPLOADING", "QUEUED", "VALIDATING", "IDENTIFYING", "EXTRACTING",
    "INDEXING", "SCANNING", "REPORTING", "RUNNING", "CANCEL_REQUESTED",
]
TERMINAL_TASK_STATUSES = ["SUCCEEDED", "PARTIAL_SUCCEEDED", "FAILED", "CANCELLED"]
JOB_KINDS = [
    "scan", "image", "native", "bytecode", "trivy", "report", "decompile",
    "c_analysis", "java_analysis",
]
JOB_STATUSES = [
    "queued", "leased", "running", "succeeded", "failed",
    "cancel_requested", "cancelled",
]
LEASED_JOB_STATUSES = ["leased", "running", "cancel_requested"]
ACTIVE_JOB_STATUSES = ["queued", "leased", "running", "cancel_requested"]
TERMINAL_RUN_STATUSES = ["succeeded", "partial", "failed", "cancelled", "timed_out"]
FAILED_RUN_STATUSES = ["failed", "timed_out"]

# --- fixed values: pipeline stages, (name, first basis point, next stage's) ----
STAGES = [
    ("VALIDATING", 0, 500),
    ("IDENTIFYING", 500, 1500),
    ("EXTRACTING", 1500, 5500),
    ("INDEXING", 5500, 7000),
    ("SCANNING", 7000, 9500),
    ("REPORTING", 9500, 10000),
]
STAGE_NAMES = [name for name, _, _ in STAGES]

# --- fixed values: limits -----------------------------------------------------
RECENT_HOURS = 168
HEARTBEAT_SECONDS = 45
STORAGE_WARNING_PERCENT = 80
STORAGE_CRITICAL_PERCENT = 90
DIAGNOSTIC_LIMIT = 1000
REFERENCE_BYTES = 2048
PYTHON_FINDING_LIMIT = 1000
INDEX_DEPTH_LIMIT = 8
MAX_EXPANDED_BYTES = 10737418240
MAX_ARCHIVE_RATIO = 50
MAX_FILE_NODES = 20000
MAX_DEPTH = 6
SNIPPET_BYTES = 1024
SNIPPET_CONTEXT_LINES = 3
BURST_THRESHOLD = 10
BURST_WINDOW_SECONDS = 60
BURST_BLOCK_SECONDS = 300

# --- fixed values: formats and categories -------------------------------------
BINARY_FORMATS = [
    "pe32", "pe32+", "elf32", "elf64", "macho-thin", "macho-fat",
    "java-class", "jar", "war", "ear", "dex", "apk", "pyc",
]
ARCHIVE_FORMATS = [
    "zip", "7z", "rar", "tar", "gzip", "bzip2", "xz", "zstd",
    "cab", "cpio", "ar", "deb", "rpm", "iso9660",
]
IMAGE_ARCHIVE_FORMATS = ["docker-tar", "oci-tar"]
DISK_IMAGE_FORMATS = ["ext2", "ext3", "ext4", "mbr-img", "gpt-img"]
FORMAT_CATEGORIES = (
    [(name, "binary") for name in BINARY_FORMATS]
    + [(name, "archive") for name in ARCHIVE_FORMATS]
    + [(name, "container") for name in IMAGE_ARCHIVE_FORMATS + DISK_IMAGE_FORMATS]
)
# An archive member may become a task only in these two categories.
MEMBER_CATEGORIES = (
    [(name, "binary") for name in BINARY_FORMATS]
    + [(name, "container") for name in IMAGE_ARCHIVE_FORMATS]
)
IMAGE_METADATA_KEYS = {
    "mbr-img": ["partition_table", "partitions", "sector_size"],
    "gpt-img": ["partition_table", "partition_slots", "partition_stride", "sector_size"],
    "ext2": ["block_size", "inodes", "blocks"],
    "ext3": ["block_size", "inodes", "blocks"],
    "ext4": ["block_size", "inodes", "blocks"],
    "squashfs": ["endianness", "version", "block_size", "compression"],
    "udf": ["revision"],
    "iso9660": [],
}

# --- fixed values: header signatures ------------------------------------------
# (detector priority, format, ((byte offset, bytes as hex), ...)); every pair of
# one row must hold. Rows of one detector share its priority.
SIGNATURES = [
    (0, "pe32", ((0, "4D5A"),)),
    (1, "elf32", ((0, "7F454C4601"),)),
    (1, "elf64", ((0, "7F454C4602"),)),
    (2, "java-class", ((0, "CAFEBABE"),)),
    (3, "macho-fat", ((0, "CAFEBABE"),)),
    (3, "macho-fat", ((0, "CAFEBABF"),)),
    (3, "macho-fat", ((0, "BEBAFECA"),)),
    (3, "macho-fat", ((0, "BFBAFECA"),)),
    (3, "macho-thin", ((0, "FEEDFACE"),)),
    (3, "macho-thin", ((0, "FEEDFACF"),)),
    (3, "macho-thin", ((0, "CEFAEDFE"),)),
    (3, "macho-thin", ((0, "CFFAEDFE"),)),
    (4, "dex", ((0, "6465780A"), (7, "00"))),
    (5, "pyc", ((2, "0D0A"),)),
    (6, "zip", ((0, "504B0304"),)),
    (6, "zip", ((0, "504B0506"),)),
    (6, "zip", ((0, "504B0708"),)),
    (7, "tar", ((257, "757374617200"),)),
    (7, "tar", ((257, "757374617220"),)),
    (8, "ar", ((0, "213C617263683E0A"),)),
    (9, "rpm", ((0, "EDABEEDB"),)),
    (10, "cpio", ((0, "303730373031"),)),
    (10, "cpio", ((0, "303730373032"),)),
    (10, "cpio", ((0, "303730373037"),)),
    (10, "cpio", ((0, "C771"),)),
    (10, "cpio", ((0, "71C7"),)),
    (11, "cab", ((0, "4D534346"),)),
    (12, "gzip", ((0, "1F8B08"),)),
    (13, "bzip2", ((0, "425A68"), (4, "314159265359"))),
    (13, "bzip2", ((0, "425A68"), (4, "177245385090"))),
    (14, "xz", ((0, "FD377A585A00"),)),
    (15, "zstd", ((0, "28B52FFD"),)),
    (16, "7z", ((0, "377ABCAF271C"),)),
    (17, "rar", ((0, "526172211A0700"),)),
    (17, "rar", ((0, "526172211A070100"),)),
    (18, "squashfs", ((0, "68737173"),)),
    (18, "squashfs", ((0, "73717368"),)),
    (19, "ext2", ((1080, "53EF"),)),
    (20, "iso9660", ((32769, "4344303031"),)),
    (20, "udf", ((32769, "4245413031"),)),
    (21, "gpt-img", ((510, "55AA"), (512, "4546492050415254"))),
    (21, "mbr-img", ((510, "55AA"),)),
]
SIGNATURE_REACH = max(
    offset + len(magic) // 2 for _, _, parts in SIGNATURES for offset, magic in parts
)

# --- fixed values: machine codes, (family, code, word size or 0, architecture) --
MACHINES = [
    ("pe", 0x014C, 0, "x86"),
    ("pe", 0x8664, 0, "x86_64"),
    ("pe", 0x01C0, 0, "arm"),
    ("pe", 0x01C2, 0, "arm"),
    ("pe", 0x01C4, 0, "arm"),
    ("pe", 0xAA64, 0, "arm64"),
    ("pe", 0x0200, 0, "ia64"),
    ("elf", 3, 0, "x86"),
    ("elf", 8, 1, "mips"),
    ("elf", 8, 2, "mips64"),
    ("elf", 20, 0, "powerpc"),
    ("elf", 21, 0, "powerpc64"),
    ("elf", 40, 0, "arm"),
    ("elf", 62, 0, "x86_64"),
    ("elf", 183, 0, "arm64"),
    ("elf", 243, 1, "riscv32"),
    ("elf", 243, 2, "riscv64"),
]

# --- fixed values: Python byte-code magic, (magic, release, header bytes) -------
PYTHON_MAGICS = [
    (62211, "2.7", 8), (3230, "3.3", 12), (3310, "3.4", 12), (3350, "3.5", 12),
    (3351, "3.5", 12), (3379, "3.6", 12), (3394, "3.7", 16), (3413, "3.8", 16),
    (3425, "3.9", 16), (3439, "3.10", 16), (3495, "3.11", 16), (3531, "3.12", 16),
    (3571, "3.13", 16), (3619, "3.14", 16), (3627, "3.14", 16),
]

# --- fixed values: C rules and their weakness classes --------------------------
C_RULE_CWES = [
    ("cwe-242-gets", "CWE-242"),
    ("cwe-120-bounds", "CWE-120"),
    ("cwe-134-format", "CWE-134"),
    ("cwe-78-command", "CWE-78"),
    ("cwe-787-oob-write", "CWE-787"),
    ("cwe-125-oob-read", "CWE-125"),
    ("cwe-562-stack-address", "CWE-562"),
    ("cwe-590-invalid-free", "CWE-590"),
    ("cwe-761-offset-free", "CWE-761"),
    ("cwe-369-zero-divisor", "CWE-369"),
    ("cwe-377-temp-file", "CWE-377"),
    ("cwe-252-unchecked-return", "CWE-252"),
    ("cwe-131-size-calculation", "CWE-131"),
    ("cwe-327-328-weak-crypto", "CWE-327"),
    ("cwe-327-328-weak-crypto", "CWE-328"),
    ("cwe-732-permissions", "CWE-732"),
]

# --- fixed values: audit metadata keys that are never shown --------------------
FORBIDDEN_METADATA_KEYS = [
    "password", "temporary_password", "current_password", "new_password",
    "token", "access_token", "refresh_token", "session", "session_id",
    "session_token", "csrf", "csrf_token", "password_hash", "hash", "secret",
    "client_ip", "user_agent",
]
FORBIDDEN_METADATA_PARTS = ["password", "token", "secret", "authorization", "cookie"]

# --- fixed values: report document fields --------------------------------------
REPORT_FIELDS = [
    "SchemaVersion", "CreatedAt", "ArtifactID", "ArtifactName", "ArtifactType",
    "Metadata", "ReportID", "Results", "Trivy",
]
REQUIRED_REPORT_FIELDS = ["SchemaVersion", "ArtifactName", "ArtifactType"]
DISABLED_REPORT_SECTIONS = ["Misconfigurations", "Secrets", "Licenses"]

# --- fixed values: allowed column values by (table, column) ---------------------
ALLOWED_VALUES = {
    ("tasks", "status"): TASK_STATUSES,
    ("tasks", "risk_level"): RISK_LEVELS,
    ("jobs", "kind"): JOB_KINDS,
    ("jobs", "status"): JOB_STATUSES,
    ("blobs", "state"): ["staging", "available", "deleting", "deleted"],
    ("uploads", "status"): [
        "created", "uploading", "assembling", "completed", "failed", "expired", "cancelled",
    ],
    ("task_events", "severity"): ["debug", "info", "warning", "error"],
    ("file_nodes", "node_type"): ["file", "directory", "symlink", "hardlink", "special"],
    ("file_nodes", "extraction_status"): [
        "indexed", "extracted", "skipped", "unsupported", "limit_reached", "failed",
    ],
    ("analyzer_runs", "status"): [
        "queued", "running", "succeeded", "partial", "failed", "cancelled", "timed_out",
    ],
    ("decompile_results", "status"): [
        "queued", "running", "complete", "partial", "bytecode_only", "unsupported",
        "failed", "cancelled",
    ],
    ("vulnerability_findings", "severity"): SEVERITIES,
    ("source_projects", "layout_version"): ["project-v1", "legacy-v1"],
    ("source_projects", "status"): ["complete", "partial", "bytecode_only"],
}


# --- fixed values: titles of checker messages, keys that no report may hold ---------
MESSAGE_TITLES = {
    "c": [
        ("cwe-242-gets", "使用 gets 读取输入，存在缓冲区溢出风险"),
        ("cwe-120-bounds", "缓冲区边界检查不足，存在溢出风险"),
        ("cwe-134-format", "不可信格式化字符串，存在格式串注入风险"),
        ("cwe-78-command", "命令注入风险（外部输入未净化）"),
        ("cwe-787-oob-write", "越界写入风险"),
        ("cwe-125-oob-read", "越界读取风险"),
        ("cwe-562-stack-address", "返回或泄露栈内存地址"),
        ("cwe-590-invalid-free", "无效的 free 调用（释放非堆内存）"),
        ("cwe-761-offset-free", "释放内存时使用错误偏移"),
        ("cwe-369-zero-divisor", "除零风险"),
        ("cwe-377-temp-file", "不安全的临时文件使用"),
        ("cwe-252-unchecked-return", "未检查函数返回值"),
        ("cwe-131-size-calculation", "尺寸计算错误导致整数溢出风险"),
        ("cwe-327-328-weak-crypto", "使用弱加密算法"),
        ("cwe-732-permissions", "不安全的文件权限设置"),
    ],
    "java": [
        ("java-weak-message-digest", "使用弱消息摘要算法"),
        ("java-weak-cipher", "使用弱加密算法"),
        ("java-legacy-tls", "使用过时或弱 TLS 配置"),
        ("java-hardcoded-crypto-key", "硬编码加密密钥"),
        ("java-trust-all-hostname-verifier", "信任所有主机名的验证器"),
        ("java-trust-all-x509-manager", "信任所有 X.509 证书的管理器"),
        ("java-xxe-enabled", "启用 XML 外部实体（XXE）风险"),
        ("java-unsafe-deserialization", "不安全的反序列化"),
        ("java-sql-injection", "SQL 注入风险"),
        ("java-command-injection", "命令注入风险"),
        ("java-dynamic-code-execution", "动态代码执行风险"),
        ("java-overly-permissive-file", "文件权限过于宽松"),
        ("java-insecure-cookie", "不安全的 Cookie 配置"),
    ],
    "python": [
        ("python-dynamic-code-execution", "动态执行代码风险"),
        ("python-command-injection", "命令注入风险"),
        ("python-unsafe-deserialization", "不安全的反序列化"),
        ("python-weak-message-digest", "使用弱消息摘要算法"),
        ("python-insecure-request", "HTTP 请求关闭了证书校验"),
    ],
    "diagnostic": [
        ("syntax_error", "源码语法错误"),
        ("function_analysis_error", "函数分析失败"),
        ("analysis_timeout", "分析超过时间限制"),
        ("file_too_large", "文件超过单文件分析大小限制"),
        ("parser_failed", "源码语法解析失败"),
        ("parser_no_ast", "解析器未生成语法树"),
        ("java_parse_problem", "源码解析存在问题"),
        ("rule_evaluation_failed", "规则评估失败"),
    ],
}
FORBIDDEN_KEYS = [
    "storagekey", "storagepath", "sourcecontent", "sourcecode", "decompiledsource", "pseudoc",
    "cachekey", "password", "passphrase", "privatekey", "secret", "apikey", "accesskey",
    "encryptionkey", "signingkey",
]
# --- end of fixed values


def mapping_column(column: Column, pairs, default: Column | None = None) -> Column:
    """Look a value up in a small fixed mapping inside the row expression."""
    out = None
    for key, value in pairs:
        out = (
            F.when(column == F.lit(key), F.lit(value))
            if out is None
            else out.when(column == F.lit(key), F.lit(value))
        )
    return out.otherwise(default) if default is not None else out


def frame(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A vocabulary as an inline table. Its size is fixed, so it may be broadcast."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            escaped = value.replace("\\", "\\\\").replace("'", "\\'")
            return f"'{escaped}'"
        return str(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {body} AS v({columns})"))


# --- fixed values: reported states with default code and text ---------------------
# (source, state, category, code, text)
DIAGNOSTIC_KINDS = (
    ("analyzer_run", "failed", "failed", "analyzer_failed", "Analyzer execution failed."),
    ("analyzer_run", "timed_out", "failed", "analyzer_failed", "Analyzer execution failed."),
    ("decompile_result", "cancelled", "failed", "decompile_cancelled", "Decompilation was cancelled."),
    ("decompile_result", "failed", "failed", "decompile_failed", "Decompilation failed."),
    ("decompile_result", "unsupported", "unsupported", "decompile_unsupported",
     "Decompilation is unsupported for this result."),
    ("file_node", "failed", "failed", "file_failed", "File processing failed."),
    ("file_node", "limit_reached", "failed", "extraction_limit_reached",
     "Extraction stopped at a configured limit."),
    ("file_node", "unsupported", "unsupported", "file_unsupported", "File format is unsupported."),
    ("task", "FAILED", "failed", "task_failed", "Task execution failed."),
    ("task_event", "warning", "warning", "task_warning", "Task warning."),
)
