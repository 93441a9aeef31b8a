"""Text of published reports: messages with titles, cleaned and indented JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlens import vocab
from cairnlens.functions.text import trim_space

JSON_BYTES = 1 << 20
JSON_DEPTH = 32
JSON_FIELDS = 1000
JSON_ITEMS = 10000
JSON_KEY_BYTES = 1024
JSON_STRING_BYTES = 65536


def display_message(checker: str, code: str, message: str) -> Column:
    """The title of a known code, with the checker's own message behind it if that says
    more; unknown codes keep the message as it is. ``checker`` is a column that names
    the table of titles."""
    titles = F.lit(None).cast("string")
    for name, pairs in vocab.MESSAGE_TITLES.items():
        table = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
        titles = F.when(F.col(checker) == name, F.try_element_at(table, F.col(code))).otherwise(titles)
    own = F.coalesce(F.col(message), F.lit(""))
    trimmed = trim_space(own)
    more = F.concat(titles, F.lit(" — "), trimmed)
    return F.when(titles.isNull(), own).when((trimmed == "") | (trimmed == titles), titles).otherwise(more)


def _parsed(text: str):
    """JSON as Python values; numbers stay text, marked by a tuple. Raises ValueError."""
    import json

    def refused(name):
        raise ValueError(name)

    number = lambda s: ("number", s)
    return json.loads(text, parse_int=number, parse_float=number, parse_constant=refused)


def _cleaned(value, depth: int) -> str:
    """Compact JSON with ordered keys, without forbidden ones. Raises ValueError."""
    import json

    if depth > JSON_DEPTH:
        raise ValueError("depth")
    if isinstance(value, dict):
        if len(value) > JSON_FIELDS or any(len(k.encode("utf-8", "replace")) > JSON_KEY_BYTES for k in value):
            raise ValueError("fields")
        kept = {k: v for k, v in value.items() if k.lower().translate({95: None, 45: None, 32: None}) not in vocab.FORBIDDEN_KEYS}
        # by the bytes of the keys, as they are written
        order = sorted(kept, key=lambda k: k.encode("utf-8", "surrogatepass"))
        return "{" + ",".join(f"{_cleaned(k, 0)}:{_cleaned(kept[k], depth + 1)}" for k in order) + "}"
    if isinstance(value, list):
        if len(value) > JSON_ITEMS:
            raise ValueError("items")
        return "[" + ",".join(_cleaned(v, depth + 1) for v in value) + "]"
    if isinstance(value, tuple):
        return value[1]
    if isinstance(value, str):
        plain = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # lone halves of a pair
        if len(plain.encode("utf-8")) > JSON_STRING_BYTES:
            raise ValueError("string")
        out = json.dumps(plain, ensure_ascii=False)
        for mark in ("<", ">", "&", "\u2028", "\u2029"):
            out = out.replace(mark, f"\\u{ord(mark):04x}")
        return out
    return json.dumps(value)


def clean_json(value: str | Column, fallback: str = "null") -> Column:
    """The JSON text without keys that may hold secrets or stored content, compact and
    with ordered keys; the fallback if it is no JSON or beyond the bounds above.

    Keys are compared without case, blanks, hyphens and underscores. Numbers keep their
    digits.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                if not text or len(text.encode("utf-8", "replace")) > JSON_BYTES:
                    return fallback
                return _cleaned(_parsed(text), 0)
            except (ValueError, RecursionError):
                return fallback

        return texts.map(one, na_action=None)

    return run(F.col(value) if isinstance(value, str) else value)


def readable_json(value: str | Column) -> Column:
    """The JSON text with a line per value and two blanks per level; ``null`` if it is no
    JSON. Order, numbers and strings stay as they are written."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import re

        token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')

        def one(text):
            try:
                if not text:
                    return "null"
                _parsed(text)
            except (ValueError, RecursionError):
                return "null"
            out, depth, fresh = [], 0, False  # fresh: right behind an opening bracket
            for part in token.findall(text):
                if part in "}]":
                    depth -= 1
                    if not fresh:
                        out.append("\n" + "  " * depth)
                elif fresh:
                    out.append("\n" + "  " * depth)
                out.append(part)
                fresh = part in "{["
                if fresh:
                    depth += 1
                elif part == ",":
                    out.append("\n" + "  " * depth)
                elif part == ":":
                    out.append(" ")
            return "".join(out)

        return texts.map(one, na_action=None)

    return run(F.col(value) if isinstance(value, str) else value)
