"""String, map, json, date and report-format expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path) -> Column:
    """File name without directories and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def basename(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path) -> Column:
    """Name of the directory that holds the file, or null at top level."""
    parts = F.split(path, "/")
    return F.get(parts, F.size(parts) - 2)


def code_map(codes: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])


def lookup(codes: Mapping[str, str], key: Column) -> Column:
    """``codes[key]`` or null."""
    return F.try_element_at(code_map(codes), key)


def sorted_json(params: Mapping[str, object]) -> str:
    """Parameters as JSON text with sorted keys."""
    return json.dumps(dict(params), sort_keys=True)


def sorted_json_column(**columns) -> Column:
    """A JSON object of columns, keys in name order."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def short_id(text, width: int = 12) -> Column:
    return F.left(F.sha2(text, 256), F.lit(width))


def utc_seconds(ts: Column) -> Column:
    """ISO-8601 text to the second, with the UTC offset."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def interval_text(point, lo, hi) -> Column:
    """``0.6311 [0.5842, 0.6760]``."""
    return F.format_string("%.4f [%.4f, %.4f]", point, lo, hi)


def delta_text(delta, lo, hi, as_pp: bool = True) -> Column:
    """``-11.11 pp [-15.02, -7.30]``."""
    scale, unit = (100.0, " pp") if as_pp else (1.0, "")
    return F.format_string(f"%+.2f{unit} [%+.2f, %+.2f]", delta * scale, lo * scale, hi * scale)


def decibels(amplitude: Column) -> Column:
    """``20 log10(amplitude)``, null where there is no signal."""
    return F.when(amplitude > 0, 20.0 * F.log10(amplitude))
