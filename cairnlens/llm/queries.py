"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlens.llm import (
    conversation_repair, fingerprint, grammar_store, language_model, licenses, mixing, near_dedup, packing, passages,
    periodic_runs, topk, toxicity, url_filter,
)
from cairnlens.llm.common import fold, read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", toxicity.FOLDS) == 0).alias("held_out"), "score", "predicted"
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.log_likelihoods(read_table(spark, sf_dir, "documents")).select(
        "doc_id", (fold("doc_id", language_model.FOLDS) == language_model.HELD_OUT).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.decide(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "mix.*")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(read_table(spark, sf_dir, "documents")).drop("check")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("sketch", ",").alias("fingerprint"),
        F.array_join("edited_sketch", ",").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(read_table(spark, sf_dir, "conversations"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = grammar_store.stored_folder(read_table(spark, sf_dir, "documents"))
    found = grammar_store.read_documents(spark, folder)
    return grammar_store.with_starts(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), folder)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.looped(read_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_score": op2_lm_score,
    "op3_license_scan": op3_license_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_fingerprint": op9_fingerprint,
    "op10_topk": op10_topk,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_ids": op12_token_ids,
    "op13_periodic_runs": op13_periodic_runs,
}



def _license_sql() -> str:
    """Phrases and block containment, from the word lists, without filters."""
    def quoted(names):
        return "[" + ", ".join(f"'{n}'" for n in names) + "]"

    starts, base, found = [], [], []
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(0, len(w)), lambda i: {test})")
    for template_label, template in licenses.TEMPLATES:
        names = licenses.distinct_words(template)
        size, step = licenses.block_words(template)
        need = licenses.needed(len(names))
        held = f"len(list_intersect({quoted(names)}, w[i:i + {size - 1}]))"
        best = f"list_max(list_transform(range(1, greatest(len(w), 1) + 1, {step}), lambda i: {held}))"
        found.append((template_label, f"CASE WHEN {best} >= {need} THEN {best} / {len(names)}::DOUBLE END"))
    columns = ", ".join(f"{s} AS p{i}" for i, s in enumerate(starts))
    columns += ", " + ", ".join(f"{t} AS t{i}" for i, (_, t) in enumerate(found))
    base = [f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(licenses.PHRASES)]
    more = [f"CASE WHEN t{i} IS NOT NULL THEN '{label}' END" for i, (label, _) in enumerate(found)]
    every = " || ".join(f"p{i}" for i in range(len(starts)))

    def joined(labels):
        return f"coalesce(array_to_string(list_sort(list_distinct([{', '.join(labels)}])), ','), '')"

    upper = licenses.UPPER
    return f"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), marked AS (SELECT doc_id, len(w) AS n_words, {columns} FROM words)
        SELECT doc_id, n_words::BIGINT AS n_words, len({every})::BIGINT AS n_base,
            list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
            {joined(base)} AS base_labels, {joined(base + more)} AS labels,
            CASE WHEN len({every}) > 0 THEN 1.0::DOUBLE
                ELSE greatest(0.0::DOUBLE, {', '.join(f'coalesce(t{i}, 0.0)' for i in range(len(found)))}) END AS score
        FROM marked
    """


def _url_sql() -> str:
    cases = {"rule": [], "ruled": []}
    for host, path, verdict in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN"
        cases["rule"].append(f"{fits} '{host}{path}'")
        cases["ruled"].append(f"{fits} '{verdict}'")
    return f"""
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://')
                THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parsed AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'),
                '{licenses.UPPER}', '{licenses.UPPER.lower()}') AS host,
                regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), ruled AS (
            SELECT *, CASE {' '.join(cases['rule'])} END AS rule,
                CASE {' '.join(cases['ruled'])} END AS own FROM parsed
        ), hosts AS (
            SELECT host, count(*) FILTER (own = 'block') AS b, count(*) FILTER (own = 'allow') AS a
            FROM ruled GROUP BY host
        )
        SELECT page_id, host, path, rule,
            coalesce(own, CASE WHEN b > 0 AND b >= a THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled JOIN hosts USING (host)
    """


def _likeness_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    every = f"(len({a}) + len({b}) - {common})"
    return f"CASE WHEN {every} = 0 THEN 1.0::DOUBLE ELSE {common} / {every}::DOUBLE END"


FINGERPRINT_SQL = f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    ordered AS (
        SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
            row_number() OVER w AS k FROM base
        WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)
    ), edited AS (
        SELECT *, length(text) AS n, left(text, length(text) - length(text) // 4)
            || left(next_text, length(text) // 4) AS edited FROM ordered
    ), split AS (
        SELECT k, kind, list_filter(string_split_regex(t, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w
        FROM (SELECT k, 'a' AS kind, text AS t FROM edited UNION ALL
            SELECT k, 'b', edited FROM edited UNION ALL SELECT k, 'c', next_text FROM edited)
    ), hashed AS (
        SELECT DISTINCT k, kind, left(md5(array_to_string(w[i:i + 4], ' ')), 16) AS h
        FROM (SELECT k, kind, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
    ), sketches AS (
        SELECT k, kind, CASE WHEN bool_or(h < '{fingerprint.LIMIT}')
            THEN list(h ORDER BY h) FILTER (h < '{fingerprint.LIMIT}') ELSE [min(h)] END AS s
        FROM hashed GROUP BY k, kind
    ), wide AS (
        SELECT e.doc_id, n, sha256(edited) AS edited_sha256, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b,
            coalesce(c.s, []) AS c
        FROM edited e LEFT JOIN sketches a ON a.k = e.k AND a.kind = 'a'
            LEFT JOIN sketches b ON b.k = e.k AND b.kind = 'b' LEFT JOIN sketches c ON c.k = e.k AND c.kind = 'c'
    )
    SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, coalesce(array_to_string(a, ','), '') AS fingerprint,
        coalesce(array_to_string(b, ','), '') AS edited_fingerprint,
        {_likeness_sql('a', 'b')} AS near_edited, {_likeness_sql('a', 'c')} AS near_next
    FROM wide
"""

TOPK_SQL = """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM usable q, usable c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
    )
    SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "[xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]"
    byte = f"list_reduce({bits}, lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}))"


def _repair_sql() -> str:
    """Least (cost, audit) of each state, row by row; labels compare as text."""
    def more(label: str, cost: str, edit: str) -> str:
        return f"(printf('%09d', left({label}, 9)::BIGINT + {cost}) || substr({label}, 10) || '{edit}')"

    def inserted(name: str) -> list[str]:  # up to two rows more before the next one
        once = [f"{name}0", f"{name}1", f"least({name}2, {more(f'least({name}0, {name}1, {name}3)', '2', 'I')})",
                f"least({name}3, {more(f'{name}2', '2', 'I')})"]
        return once

    def closed(source: str, columns: str) -> str:
        step = f"SELECT {columns}, {', '.join(f'{e} AS q{i}' for i, e in enumerate(inserted('q')))} FROM"
        return f"({step} ({step} {source}))"

    del_ = [more(f"q{i}", "3", "D") for i in range(4)]
    kept = [None, more("q0", "late", "K"), more("least(q0, q1, q3)", "late", "K"), more("q2", "late", "K")]
    role = [None, "s", "u", "a"]
    given = [None, None, more("least(q0, q1, q3)", "2 + late", "R"), more("q2", "2 + late", "R")]
    after = []
    for i in range(4):
        options = [del_[i]]
        if kept[i]:
            options.append(f"CASE WHEN sound AND initial = '{role[i]}' THEN {kept[i]} END")
        if given[i]:
            options.append(f"CASE WHEN sound THEN {given[i]} END")
        after.append(f"least({', '.join(options)}) AS q{i}" if len(options) > 1 else f"{options[0]} AS q{i}")
    return f"""
        WITH RECURSIVE base AS (
            SELECT coalesce(conv_id::VARCHAR, ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role,
                coalesce(text, ' ') AS text, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
            FROM conversations
        ), damaged AS (
            SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM base WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
        ), told AS (
            SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS again,
                regexp_replace(text, '[\x20\x09-\x0D]+\\z', '') AS trimmed, left(role, 1) AS initial FROM placed
        ), marked AS (
            SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS duplicate,
                trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated FROM told
        ), steps AS (SELECT *, NOT (blank OR duplicate) AS sound, truncated::INTEGER AS late FROM marked),
        walk(key, pos, q0, q1, q2, q3) AS (
            SELECT DISTINCT key, 0::BIGINT, printf('%09d', 0), NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM marked
            UNION ALL
            SELECT w.key, s.pos, {', '.join(after)}
            FROM {closed('walk', 'key, pos')} w JOIN steps s ON s.key = w.key AND s.pos = w.pos + 1
        ), ends AS (
            SELECT key, least(q0, q3) AS label FROM {closed('walk', 'key, pos')}
            QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1
        ), audits AS (SELECT key, left(label, 9)::BIGINT AS cost, substr(label, 10) AS audit FROM ends),
        letters AS (
            SELECT key, audit, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS number FROM audits WHERE audit <> ''
        ), read AS (
            SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w AS n FROM letters
            WINDOW w AS (PARTITION BY key ORDER BY number)
        ), joined AS (
            SELECT r.key, r.number, r.n, r.edit, m.role, m.text, m.initial FROM read r
            LEFT JOIN marked m ON m.key = r.key AND m.pos = r.pos AND r.edit <> 'I' WHERE r.edit <> 'D'
        ), shifted AS (
            SELECT *, bool_or(n = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY key) AS opened FROM joined
        ), repaired AS (
            SELECT key, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - opened::BIGINT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY number) AS text
            FROM shifted GROUP BY key
        ), pairs AS (
            SELECT key, initial || lead(initial) OVER (PARTITION BY key ORDER BY pos) AS pair FROM marked
        ), illegal AS (SELECT key, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY key),
        facts AS (
            SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated FROM marked GROUP BY key
        )
        SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
            coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
            sha256(coalesce(r.text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, key FROM base) i LEFT JOIN facts USING (key) LEFT JOIN illegal USING (key)
            LEFT JOIN audits USING (key) LEFT JOIN repaired r USING (key)
    """


RUNS_SQL = f"""
    WITH split AS (
        SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words,
            {_crc32_sql('doc_id::VARCHAR')} AS h FROM documents
    ), numbers AS (SELECT *, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS turns, h // 10 AS g FROM split),
    looped AS (
        SELECT r, doc_id, n, CASE WHEN turns THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < g % n THEN i
            ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE words END AS w FROM numbers
    ), grams AS (
        SELECT r, unnest(list_transform(range(1, n - {periodic_runs.LEAST // 2 - 2}), lambda i: w[i:i + {periodic_runs.LEAST // 2 - 1}])) AS gram,
            unnest(range(0, n - {periodic_runs.LEAST // 2 - 1})) AS i
        FROM looped WHERE n >= {periodic_runs.LEAST}
    ), same AS (
        SELECT a.r, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i
    ), islands AS (
        SELECT r, q, min(i) AS start, count(*) + {periodic_runs.LEAST // 2 - 1} + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island
    ), runs AS (
        SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest({periodic_runs.LEAST}, 2 * q) GROUP BY r, start, length
    ), facts AS (
        SELECT r, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY r
    ), dropped AS (
        SELECT r, list_sort(list_distinct(flatten(list(range(start + period, start + length))))) AS gone FROM runs GROUP BY r
    ), kept AS (
        SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS text
        FROM (SELECT r, w, unnest(range(n)) AS i FROM looped) l
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS i FROM dropped) d WHERE d.r = l.r AND d.i = l.i) GROUP BY r
    )
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
        best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
    FROM looped LEFT JOIN facts USING (r) LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": _license_sql(),
    "op8_url_filter": _url_sql(),
    "op9_fingerprint": FINGERPRINT_SQL,
    "op10_topk": TOPK_SQL,
    "op11_conversation_repair": _repair_sql(),
    "op13_periodic_runs": RUNS_SQL,
}
