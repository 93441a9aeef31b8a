"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

# Input tables.
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# One vulnerability report document.
VULNERABILITY = (
    "VulnerabilityID STRING, PkgName STRING, PkgPath STRING, InstalledVersion STRING, "
    "FixedVersion STRING, Severity STRING, Title STRING, Description STRING, "
    "PrimaryURL STRING, DataSource STRUCT<ID: STRING, Name: STRING, URL: STRING>, "
    "References ARRAY<STRING>"
)
REPORT_RESULT = (
    "Target STRING, Class STRING, Type STRING, "
    f"Vulnerabilities ARRAY<STRUCT<{VULNERABILITY}>>, "
    "Misconfigurations STRING, Secrets STRING, Licenses STRING"
)
REPORT = (
    "SchemaVersion BIGINT, ArtifactName STRING, ArtifactType STRING, "
    f"Results ARRAY<STRUCT<{REPORT_RESULT}>>"
)

# One program index document.
PROGRAM_INDEX = (
    "schema_version INT, format STRING, architecture STRING, completeness STRING, "
    "candidate_function_count BIGINT, decompiled_function_count BIGINT, "
    "entry_points ARRAY<STRUCT<address: STRING, symbol: STRING>>, "
    "segments ARRAY<STRUCT<name: STRING, start: STRING, end: STRING, size_bytes: BIGINT, "
    "permissions: STRING, initialized: BOOLEAN, overlay: BOOLEAN>>, "
    "functions ARRAY<STRUCT<name: STRING, address: STRING, size_bytes: BIGINT, "
    "source_file: STRING, sha256: STRING, source_size: BIGINT>>, "
    "call_edges ARRAY<STRUCT<caller_address: STRING, callee_address: STRING, "
    "callee_name: STRING, external: BOOLEAN>>"
)

# One class of a class index document.
CLASS_INDEX = (
    "class_key STRING, entry_path STRING, selected_release INT, binary_name STRING, "
    "minor_version INT, major_version INT, access_flags INT, sha256 STRING, "
    "methods ARRAY<STRUCT<method_key: STRING, name: STRING, descriptor: STRING, "
    "access_flags: INT, code: STRUCT<offset_bytes: BIGINT, size_bytes: BIGINT, "
    "sha256: STRING, bytecode_hex: STRING>>>"
)

# Event log rows, also the live source.
TASK_EVENT = (
    "task_id BIGINT, event_sequence BIGINT, event_type STRING, stage STRING, "
    "severity STRING, message STRING, payload STRING, created_at TIMESTAMP"
)
