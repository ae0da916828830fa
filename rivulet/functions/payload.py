"""Record payload expressions: base64, JSON, field projection, de-aggregation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T


def decode_payload(data: Column) -> Column:
    """Base64 text to UTF-8 text; null when the text is not base64."""
    return F.try_to_binary(data, F.lit("base64")).cast("string")


def encode_payload(text: Column) -> Column:
    """Base64 on one line: the built-in breaks lines after 76 characters."""
    return F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit(""))


def json_line(columns: list[str]) -> Column:
    """One compact JSON object; null fields are left out."""
    return F.to_json(F.struct(*columns))


_PATH = re.compile(r"^\$?(\.[A-Za-z_][A-Za-z0-9_]*)+$")


def _field_tree(paths: list[list[str]]) -> T.StructType:
    heads: dict[str, list[list[str]]] = {}
    for path in paths:
        heads.setdefault(path[0], []).append(path[1:])
    fields = []
    for name, tails in heads.items():
        if all(tails):
            fields.append(T.StructField(name, _field_tree(tails)))
        elif any(tails):
            raise ValueError(f"{name!r} is asked for both as a value and as an object")
        else:
            fields.append(T.StructField(name, T.StringType()))
    return T.StructType(fields)


def project_fields(payload: Column, keys: dict[str, str], name: str) -> tuple[Column, dict[str, Column]]:
    """Field projections ``{key: ".path.to.field"}``: the payload parsed once, to be put into column
    ``name``, and the columns that read it."""
    for path in keys.values():
        if not _PATH.match(path):
            raise ValueError(f"not a field path: {path!r}")
    parts = {key: path.lstrip("$").lstrip(".").split(".") for key, path in keys.items()}
    fields = {}
    for key, path in parts.items():
        fields[key] = F.col(name)
        for step in path:
            fields[key] = fields[key].getField(step)
    return F.from_json(payload, _field_tree(list(parts.values()))), fields


# Control characters cannot stand unescaped in JSON text, so they are safe as marks.
_CUT, _BACKSLASH, _QUOTE = "\u0001", "\u0002", "\u0003"


def split_objects(payload: Column) -> Column:
    """Array of the JSON objects concatenated in one payload.

    Two objects meet where ``}`` is followed by ``{`` outside a string. Escapes are masked first, so
    that a string is simply text between two quotes and no pattern needs to backtrack.
    """
    masked = F.replace(payload, F.lit("\\\\"), F.lit(_BACKSLASH))
    masked = F.replace(masked, F.lit('\\"'), F.lit(_QUOTE))
    pieces = F.regexp_extract_all(masked, F.lit(r'("[^"]*"|\}\s*\{|[^"}]+|\}|")'), F.lit(1))
    marked = F.transform(
        pieces, lambda piece: F.when(piece.rlike(r"^\}\s*\{$"), F.lit("}" + _CUT + "{")).otherwise(piece)
    )
    whole = F.array_join(marked, "")
    whole = F.replace(whole, F.lit(_QUOTE), F.lit('\\"'))
    whole = F.replace(whole, F.lit(_BACKSLASH), F.lit("\\\\"))
    return F.transform(F.split(whole, _CUT), F.trim)
