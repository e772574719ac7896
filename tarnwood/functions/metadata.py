"""Fields inside JSON metadata documents: a typed registry, open keys, and a flat view for display."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Format groups, then field, JSON path below the document, type and groups it applies to.
GROUPS: dict[str, tuple[str, ...]] = {
    "tabular": ("csv", "parquet", "json", "arrow"),
    "spreadsheet": ("xlsx", "xls", "ods"),
    "image": ("jpeg", "png", "tiff", "web_p", "gif", "bmp"),
    "audio": ("mp3", "flac", "wav", "ogg", "aac"),
    "video": ("mp4", "mkv", "avi", "web_m"),
    "archive": ("zip", "tar", "seven_zip", "rar"),
    "vtk": ("vtk_legacy", "vtu", "vtp", "vts", "vtr", "vti"),
    "zarr": ("zarr_v2", "zarr_v3"),
}
TOP_FIELDS = (
    ("num_rows", "num_rows", "bigint", "tabular spreadsheet"),
    ("num_columns", "num_columns", "bigint", "tabular spreadsheet"),
    ("completeness", "data_quality.completeness", "double", "tabular spreadsheet"),
    ("schema", "schema_fingerprint.digest", "string", ""),
    ("encrypted", "encrypted", "boolean", ""),
)
DETAIL_FIELDS = (
    ("width", "bigint", "image video"),
    ("height", "bigint", "image video"),
    ("duration_secs", "double", "audio video"),
    ("delimiter", "string", "csv"),
    ("encoding", "string", "csv"),
    ("has_header", "boolean", "csv"),
    ("compression", "string", "parquet image archive"),
    ("num_row_groups", "bigint", "parquet"),
    ("color_space", "string", "image"),
    ("bit_depth", "bigint", "image audio"),
    ("channels", "bigint", "image audio"),
    ("animated", "boolean", "png gif web_p"),
    ("sample_rate", "bigint", "audio"),
    ("codec", "string", "audio"),
    ("bitrate_kbps", "bigint", "audio video"),
    ("fps", "double", "video"),
    ("video_codec", "string", "video"),
    ("audio_codec", "string", "video"),
    ("num_entries", "bigint", "archive"),
    ("num_sheets", "bigint", "spreadsheet"),
    ("zarr_version", "bigint", "zarr"),
    ("num_arrays", "bigint", "zarr"),
    ("dataset_type", "string", "vtk"),
    ("num_points", "bigint", "vtk"),
    ("num_cells", "bigint", "vtk"),
    ("conventions", "string", "net_cdf"),
    ("num_hdus", "bigint", "fits"),
)
# Units by field name.
UNITS = {"sample_rate": "Hz", "bitrate_kbps": "kbps", "width": "px", "height": "px", "fps": "fps", "dpi": "dpi", "channels": "ch"}


def metadata_format(doc: Column) -> Column:
    """The format's name; an unknown format is held as an object that names it."""
    return F.coalesce(F.get_json_object(doc, "$.format.unknown"), F.when(~F.get_json_object(doc, "$.format").startswith("{"), F.get_json_object(doc, "$.format")))


def metadata_fields(doc: Column) -> dict[str, tuple[Column, T.DataType]]:
    """``meta.<name>`` -> (column, type); what is absent or doesn't cast is null."""
    paths = [(n, p, k) for n, p, k, _ in TOP_FIELDS] + [(n, f"format_specific.details.{n}", k) for n, k, _ in DETAIL_FIELDS]
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
    found = {f"meta.{n}": (F.get_json_object(doc, f"$.{p}").try_cast(k), kinds[k]) for n, p, k in paths}
    return {"meta.format": (metadata_format(doc), T.StringType()), **found}


def applies_to(name: str) -> tuple[str, ...]:
    """Formats that carry the field ``meta.<name>``; none stands for all."""
    groups = {n: g for n, *_, g in (*TOP_FIELDS, *DETAIL_FIELDS)}[name].split()
    return tuple(f for g in groups for f in GROUPS.get(g, (g,)))


def open_field(doc: Column, key: str) -> Column:
    """Any key of a flat JSON object as text; the key is a value, never part of a path."""
    return F.try_element_at(F.from_json(doc, "map<string,string>"), F.lit(key))


def asset_pinned(pins: Column, asset: str) -> Column:
    """True where any alias of a JSON object of pins holds the asset."""
    held = F.from_json(pins, "map<string,struct<asset_id:string>>")
    return F.coalesce(F.exists(F.map_values(held), lambda p: p["asset_id"] == asset), F.lit(False))


def _text(value) -> str:
    if isinstance(value, list):
        return ", ".join(map(_text, value))
    if isinstance(value, dict) and len(value) == 1 and isinstance(only := next(iter(value.values())), str):
        return only
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _size(n: float) -> str:
    power = 0
    while n >= 1024 and power < 5:
        n, power = n / 1024, power + 1
    return f"{n:.1f} {'KMGTP'[power - 1]}B" if power else f"{n} B"


def _clock(seconds: float) -> str:
    minutes, s = divmod(int(seconds + 0.5), 60)
    h, m = divmod(minutes, 60)
    return f"{h}:{m:02}:{s:02}" if h else f"{m}:{s:02}"


def _row(path: str, value) -> tuple[str, str, str | None]:
    """Label, shown value and unit of one leaf, by its last name."""
    leaf = path.rpartition(".")[2]
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 0
    if isinstance(value, list):
        return path.replace("_", " "), _text(value), None
    if number and leaf == "duration_secs":
        return "duration", _clock(value), None
    if number and isinstance(value, int) and leaf.endswith(("_size", "_bytes")):
        return leaf.rpartition("_")[0].replace("_", " "), _size(value), None
    return ("bitrate" if leaf == "bitrate_kbps" else leaf).replace("_", " "), _text(value), UNITS.get(leaf)


def _view(text: str | None) -> dict:
    """Leaves as rows, lists with objects as tables; nulls and empty lists are left out."""
    try:
        todo = list(json.loads(text or "{}").items())
    except (ValueError, AttributeError):
        todo = []
    out = {"fields": [], "tables": []}
    while todo:
        path, value = todo.pop(0)
        if isinstance(value, dict):
            todo[:0] = [(f"{path}.{k}", v) for k, v in value.items()]
        elif isinstance(value, list) and any(isinstance(i, dict) for i in value):
            names = list(dict.fromkeys(k for i in value if isinstance(i, dict) for k in i))
            if names:
                cells = [[_text(i.get(n)) if isinstance(i, dict) else "" for n in names] for i in value]
                out["tables"].append({"title": path.replace("_", " "), "columns": [n.replace("_", " ") for n in names], "cells": cells})
        elif value is not None and value != []:
            out["fields"].append(dict(zip(("label", "value", "unit"), _row(path, value))))
    return out


_WORDS = T.ArrayType(T.StringType())
_FIELD = T.StructType([T.StructField(n, T.StringType()) for n in ("label", "value", "unit")])
_TABLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("columns", _WORDS), T.StructField("cells", T.ArrayType(_WORDS))])


@F.pandas_udf(T.StructType([T.StructField("fields", T.ArrayType(_FIELD)), T.StructField("tables", T.ArrayType(_TABLE))]))
def details_view(details: pd.Series) -> pd.DataFrame:
    """A JSON object of format details as display fields and tables; broken text gives none."""
    made = [_view(t) for t in details]
    return pd.DataFrame({c: pd.Series([m[c] for m in made], dtype=object) for c in ("fields", "tables")})
