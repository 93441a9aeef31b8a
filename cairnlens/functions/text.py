"""Text, path, digest and number functions, all as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlens import vocab

# --- fixed values: character classes -------------------------------------------
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CHARACTERS = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CONTROL = r"[\x00-\x1F\x7F]"
CONTROL_BUT_BREAKS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
UNSAFE_DISPLAY = r"[\p{Cc}\p{Cf}\x{2028}\x{2029}]"
BAD_ESCAPE = r"%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)"
URL_TAIL = r"[^\x00-\x20\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
URL_HOST = URL_TAIL.replace("[^", "[^/?#@:\\[\\]").replace("]*", "]+")
# most texts and addresses pass these cheaper tests, which say that the dear steps change nothing
PLAIN_LINE = r"^[!-~]*(?: [!-~]+)*$"
PLAIN_URL = r"^https?://[A-Za-z0-9.\-]+(?::[0-9]*)?(?:[/?#][!-$&-~]*)?$"
HTTP_URL = rf"^(?:[hH][tT][tT][pP][sS]?)://(?:\[[0-9A-Fa-f:.]+\]|{URL_HOST})(?::[0-9]*)?(?:[/?#]{URL_TAIL})?$"
# lines of visible ASCII and blanks: those that are addresses, and what only the slow steps settle
VISIBLE = r"\A[ -~]*+\z"
_HOST = "".join(rf"\{c}" if not c.isalnum() else c for c in map(chr, range(33, 127)) if c not in "/?#@:[]")
URL_LINE = rf"(?m)^ *+(https?://(?:[{_HOST}]++|\[[0-9A-Fa-f:.]++\])(?::[0-9]*+)?(?:[/?#][!-~]*+)?) *+$"
OPEN_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
CAPITAL_SCHEME = r"(?m)^ *+(?!https?:)(?i:https?:)"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_space(value: str | Column) -> Column:
    """Remove every kind of Unicode space at both ends."""
    return F.btrim(_column(value), F.lit(SPACE_CHARACTERS))


def visible_start(value: str | Column) -> Column:
    """Whether the first character is a visible ASCII one, by two comparisons of texts."""
    text = _column(value)
    return (text >= F.lit("!")) & (text < F.lit("\x7f"))


def trim_column(value: str | Column) -> Column:
    """``trim_space`` of a column: a text with visible ASCII characters at both ends stays
    as it is, which is seen without a search in the list of spaces."""
    text = _column(value)
    plain = visible_start(text) & visible_start(F.substring(text, -1, 1))
    return F.when(plain, text).otherwise(trim_space(text))


def cut_bytes(value: str | Column, maximum: int) -> Column:
    """At most ``maximum`` UTF-8 bytes, ending in "..." when cut."""
    text = _column(value)
    raw = text.cast("binary")
    room = maximum - 3
    prefixes = [
        F.try_validate_utf8(F.substring(raw, 1, room - back).cast("string"))
        for back in range(4)
    ]
    cut = F.concat(trim_space(F.coalesce(*prefixes)), F.lit("..."))
    return F.when(F.octet_length(text) <= maximum, text).otherwise(cut)


def display_text(value: str | Column, maximum: int) -> Column:
    """One-line text: spaces collapsed, cut in bytes; null when it holds controls."""
    return display_trimmed(trim_space(value), maximum)


def display_trimmed(trimmed: Column, maximum: int) -> Column:
    """``display_text`` of a text that is trimmed already."""
    one_line = F.regexp_replace(trimmed, f"[{SPACE}]+", " ")
    plain = (F.octet_length(trimmed) <= maximum) & F.rlike(trimmed, F.lit(PLAIN_LINE))
    return F.when(plain, trimmed).when(
        ~F.rlike(trimmed, F.lit(CONTROL_BUT_BREAKS)), cut_bytes(one_line, maximum)
    )


def http_url(value: str | Column, maximum: int = vocab.REFERENCE_BYTES) -> Column:
    """A usable http(s) address without user info, else the empty string."""
    return usable_url(trim_space(value), maximum)


def usable_url(url: Column, maximum: int = vocab.REFERENCE_BYTES) -> Column:
    """``http_url`` of a text that is trimmed already."""
    usable = (
        (F.octet_length(url) <= maximum)
        & F.rlike(url, F.lit(HTTP_URL))
        & (
            ~F.contains(url, F.lit("%"))
            | ~F.rlike(F.regexp_extract(url, r"^([^?]*)", 1), F.lit(BAD_ESCAPE))
        )
    )
    scheme = F.lower(F.substring_index(url, ":", 1))
    rest = F.substr(url, F.char_length(scheme) + 1)
    usual = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    plain = (F.octet_length(url) <= maximum) & F.rlike(url, F.lit(PLAIN_URL))
    return F.when(plain, url).when(
        usable, F.when(usual, url).otherwise(F.concat(scheme, rest))
    ).otherwise(F.lit(""))


def report_target(artifact: str | Column, target: str | Column) -> Column:
    """Readable scan target: the artifact's own name is not repeated."""
    return trimmed_target(trim_space(artifact), trim_space(target))


def trimmed_target(name: Column, full: Column) -> Column:
    """``report_target`` of texts that are trimmed already."""
    rest = trim_space(F.substr(full, F.char_length(name) + 1))
    inner = trim_space(F.regexp_extract(rest, r"^\((.*)\)$", 1))
    return (
        F.when(name == "", full)
        .when(full == name, "container image")
        .when(~F.startswith(full, F.concat(name, F.lit(" "))), full)
        .when(inner != "", inner)
        .otherwise(rest)
    )


def readable_target(target: str | Column) -> Column:
    """Report-page form: a trailing "(…)" wins, layout digests get a plain name."""
    full = trim_space(target)
    inner = trim_space(F.regexp_extract(full, r"(?s)^.* \((.*)\)$", 1))
    return (
        F.when(inner != "", inner)
        .when(F.contains(full, F.lit("/oci-layout@sha256:")), "container image")
        .otherwise(full)
    )


def safe_display(value: str | Column) -> Column:
    return F.regexp_replace(_column(value), UNSAFE_DISPLAY, "\uFFFD")


def valid_text(value: str | Column, maximum: int, required: bool = True) -> Column:
    text = _column(value)
    good = (F.octet_length(text) <= maximum) & ~F.rlike(text, F.lit(CONTROL))
    if required:
        good = good & (trim_space(text) != "")
    return F.coalesce(good, F.lit(not required))


def _clean_segments(path: Column) -> Column:
    """No empty, "." or ".." segment and no trailing slash."""
    return ~F.rlike(path, F.lit(r"//|/$|(^|/)\.{1,2}(/|$)"))


def relative_path(value: str | Column) -> Column:
    """Path below the root, or null when the absolute path is not clean."""
    path = _column(value)
    relative = F.substr(path, F.lit(2))
    good = (
        F.startswith(path, F.lit("/"))
        & (path != "/")
        & _clean_segments(path)
        & ~F.rlike(path, F.lit(CONTROL))
        & (F.octet_length(relative) <= 2048)
    )
    return F.when(good, relative)


def safe_member_path(value: str | Column) -> Column:
    """A relative archive path without tricks."""
    path = _column(value)
    return (
        (path != "")
        & (F.octet_length(path) <= 1024)
        & ~F.startswith(path, F.lit("/"))
        & _clean_segments(path)
        & ~F.rlike(path, F.lit(r"\\|\x00"))
    )


def java_source_path(value: str | Column) -> Column:
    path = _column(value)
    return (
        (F.octet_length(path) <= 1024)
        & F.startswith(path, F.lit("src/main/java/"))
        & F.endswith(F.lower(path), F.lit(".java"))
        & ~F.contains(path, F.lit("\\"))
        & _clean_segments(path)
    )


def parent_path(path: str | Column) -> Column:
    """Folder part of an absolute path; "/" for the first level."""
    return blank_root(F.regexp_extract(_column(path), r"^(.*)/[^/]*$", 1))


def blank_root(path: Column) -> Column:
    return F.when(path == "", "/").otherwise(path)


def base_name(path: str | Column) -> Column:
    return F.substring_index(_column(path), "/", -1)


def archive_task_name(archive: str | Column, entry: str | Column) -> Column:
    """"<archive> :: <path>" in 255 characters: the path loses its left part."""
    name, path = _column(archive), _column(entry)
    short = F.when(
        F.char_length(name) > 80, F.concat(F.substring(name, 1, 77), F.lit("..."))
    ).otherwise(name)
    room = F.lit(251) - F.char_length(short)
    tail = F.when(
        F.char_length(path) > room, F.concat(F.lit("..."), F.right(path, room - 3))
    ).otherwise(path)
    whole = F.concat(name, F.lit(" :: "), path)
    return F.when(F.char_length(whole) <= 255, whole).otherwise(
        F.concat(short, F.lit(" :: "), tail)
    )


def stable_key(prefix: str, *parts: str | Column) -> Column:
    """Digest of length-prefixed parts, so no two part lists collide."""
    pieces: list[Column] = []
    for part in parts:
        text = _column(part).cast("string")
        pieces += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat(*pieces), 256))


def joined_key(*parts: str | Column) -> Column:
    """Digest of parts separated by NUL."""
    texts = [_column(part).cast("string") for part in parts]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x00", *texts), 256))


def storage_key(digest: str | Column) -> Column:
    text = _column(digest)
    return F.concat(F.lit("blobs/sha256/"), F.substring(text, 1, 2), F.lit("/"), text)


def newline_count(value: str | Column) -> Column:
    text = _column(value)
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_span(value: str | Column) -> Column:
    """Lines of a text that only LF ends; an open last line counts."""
    text = _column(value)
    open_end = F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return F.when(text == "", 0).otherwise(newline_count(text) + open_end)


def line_count(value: str | Column) -> Column:
    """Lines of a text that CRLF, CR or LF ends; an open last line counts."""
    text = _column(value)
    breaks = F.regexp_count(text, F.lit(r"\r\n|\r|\n"))
    open_end = F.when(F.rlike(F.right(text, F.lit(1)), F.lit(r"[\r\n]")), 0).otherwise(1)
    return F.when(text == "", 0).otherwise(breaks + open_end)


def weighted_progress(stage: str | Column, local_points: str | Column) -> tuple[Column, Column]:
    """(overall basis points, indeterminate flag); null for an unknown stage."""
    name, local = F.upper(trim_space(stage)), _column(local_points)
    start = vocab.mapping_column(name, [(n, s) for n, s, _ in vocab.STAGES])
    weight = vocab.mapping_column(name, [(n, e - s) for n, s, e in vocab.STAGES])
    part = F.floor(weight * local / 10000).cast("int")
    points = F.when(local.isNull(), start).when(local <= 10000, start + part)
    unknown = F.when(start.isNotNull(), local.isNull() & (name != "REPORTING"))
    return points, unknown


def indeterminate(stage: str | Column, points: str | Column) -> Column:
    """Whether stored progress still sits at the start of its stage."""
    name = F.upper(trim_space(stage))
    start = vocab.mapping_column(name, [(n, s) for n, s, _ in vocab.STAGES])
    return F.coalesce((name != "REPORTING") & (start == _column(points)), F.lit(False))


def progress_percent(points: str | Column) -> Column:
    return _column(points) / 100.0


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.unix_micros(_column(end)) - F.unix_micros(_column(start))


def mean_millis(micros: Column) -> Column:
    """Mean of microsecond spans in whole milliseconds, halves rounded up."""
    mean = F.sum(micros).cast("decimal(38,6)") / F.count(micros).cast("decimal(20,0)")
    return F.round(mean / F.lit(1000).cast("decimal(10,0)"), 0).cast("bigint")


def ratio_exceeded(expanded: str | Column, packed: str | Column, ratio: int) -> Column:
    """Exact integer test of expanded > packed * ratio, free of overflow."""
    u, c = _column(expanded), _column(packed)
    quotient = F.call_function("div", u, F.nullif(c, F.lit(0)))
    rest = u % F.nullif(c, F.lit(0))
    return (
        F.when(u == 0, False)
        .when((c == 0) | F.lit(ratio == 0), True)
        .otherwise((quotient > ratio) | ((quotient == ratio) & (rest != 0)))
    )


def low_high_byte(value: str | Column) -> Column:
    """Two little-endian bytes as a number."""
    raw = F.hex(_column(value))
    swapped = F.concat(F.substring(raw, 3, 2), F.substring(raw, 1, 2))
    return F.conv(swapped, 16, 10).cast("bigint")


def bounded_strings(values: str | Column, maximum_items: int, maximum_bytes: int) -> Column:
    """Trimmed, usable, distinct strings, the first ones in order."""
    trimmed = F.transform(_column(values), lambda x: trim_space(x))
    kept = F.filter(
        trimmed,
        lambda x: (x != "")
        & (F.octet_length(x) <= maximum_bytes)
        & ~F.rlike(x, F.lit(CONTROL)),
    )
    return F.slice(F.array_distinct(kept), 1, maximum_items)


def merged_references(primary: str | Column, listed: str | Column, source: str | Column) -> Column:
    """Usable addresses: primary, then the list, then the data source, once each.

    Most lists are joined to lines of which one pattern takes the usable ones; the others
    are looked at one address at a time.
    """
    none = F.array().cast("array<string>")
    parts = [_column(primary), F.coalesce(_column(listed), none), _column(source)]
    flat, lines = F.concat_ws("", *parts), F.concat_ws("\n", *parts)
    joinable = (
        F.rlike(flat, F.lit(VISIBLE))
        & lines_within(flat, lines, vocab.REFERENCE_BYTES)
        & (~F.contains(flat, F.lit("%")) | ~F.rlike(lines, F.lit(OPEN_ESCAPE)))
        & ((F.lower(lines) == lines) | ~F.rlike(lines, F.lit(CAPITAL_SCHEME)))
    )
    usual = F.regexp_extract_all(lines, F.lit(URL_LINE), F.lit(1))
    return F.array_distinct(
        F.when(joinable, usual).otherwise(_usable_urls(primary, listed, source))
    )


def lines_within(flat: Column, lines: Column, maximum: int) -> Column:
    """Whether no line of ASCII text, also given without its breaks, is longer."""
    return (F.octet_length(flat) <= maximum) | ~F.rlike(lines, F.lit(rf"(?m)^.{{{maximum + 1}}}"))


def _usable_urls(primary: str | Column, listed: str | Column, source: str | Column) -> Column:
    """Usable addresses in order, one at a time."""
    every = F.concat(
        F.array(F.coalesce(_column(primary), F.lit(""))),
        F.coalesce(_column(listed), F.array().cast("array<string>")),
        F.array(F.coalesce(_column(source), F.lit(""))),
    )
    trimmed = F.transform(every, lambda x: trim_space(x))
    return F.filter(F.transform(trimmed, lambda x: usable_url(x)), lambda x: x != "")


def json_string(variant: Column, path: str) -> Column:
    """The value at a path only if it is a JSON string."""
    value = F.try_variant_get(variant, path, "variant")
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, path, "string")
    )


def first_symbol_text(variant: Column, keys: list[str], fallback: Column) -> Column:
    """First usable text of the keys in the object, then in its "symbol" object."""
    candidates = [json_string(variant, f"$.{prefix}{key}") for prefix in ("", "symbol.") for key in keys]
    usable = [
        F.when((text != "") & (F.octet_length(text) <= 8192), text) for text in candidates
    ]
    return F.coalesce(*usable, fallback)


def symbol_kind(value: str | Column) -> Column:
    kind = F.lower(trim_space(value))
    return F.when(kind.isin("function", "class", "method", "module"), kind).otherwise("unknown")


def safe_json(value: str | Column) -> Column:
    """The text if it is JSON, else null."""
    text = _column(value)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def cut_plain(value: str | Column, maximum: int) -> Column:
    """At most ``maximum`` bytes, ending at a character boundary."""
    text = _column(value)
    raw = text.cast("binary")
    prefixes = [
        F.try_validate_utf8(F.substring(raw, 1, maximum - back).cast("string"))
        for back in range(4)
    ]
    return F.when(F.octet_length(text) <= maximum, text).otherwise(F.coalesce(*prefixes))
