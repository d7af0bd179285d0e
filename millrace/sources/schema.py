"""Declared schemas: JSON to Spark types with roles and defaults, and back. Nothing is inferred."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

_ROLES = {"DIMENSION": "dimensionFieldSpecs", "METRIC": "metricFieldSpecs", "DATE_TIME": "dateTimeFieldSpecs"}
_TYPES = {
    "INT": (T.IntegerType(), -(1 << 31)),
    "LONG": (T.LongType(), -(1 << 63)),
    "FLOAT": (T.FloatType(), float("-inf")),
    "DOUBLE": (T.DoubleType(), float("-inf")),
    "STRING": (T.StringType(), "null"),
    "BYTES": (T.BinaryType(), b""),
}


@dataclass(frozen=True)
class Field:
    """A declared column. default stands for a missing cell; None takes the type's own."""

    name: str
    kind: str
    role: str = "DIMENSION"
    single: bool = True
    default: int | float | str | bytes | None = None

    def __post_init__(self):
        if self.kind not in _TYPES:
            raise ValueError(f"{self.name}: there is no type {self.kind}; there are {', '.join(_TYPES)}")
        if self.role not in _ROLES:
            raise ValueError(f"{self.name}: there is no role {self.role}")

    @property
    def spark_type(self) -> T.DataType:
        base = _TYPES[self.kind][0]
        return base if self.single else T.ArrayType(base, False)

    @property
    def missing(self):
        return _TYPES[self.kind][1] if self.default is None else self.default


def _value(text: str, kind: str):
    if kind in ("INT", "LONG"):
        return int(text.strip())
    if kind in ("FLOAT", "DOUBLE"):
        return float(text.strip())
    return text.encode() if kind == "BYTES" else text


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name} names a column twice")

    @staticmethod
    def from_json(text: str) -> Schema:
        root, fields = json.loads(text), []
        for role, key in _ROLES.items():
            for spec in root.get(key) or []:
                kind = spec["dataType"].upper()
                given = spec.get("defaultNullValue")
                fields.append(Field(spec["name"], kind, role, spec.get("singleValueField", True), None if given is None else _value(str(given), kind)))
        return Schema(root.get("schemaName", "unnamed"), tuple(fields))

    @staticmethod
    def from_file(path: str) -> Schema:
        with open(path, encoding="utf-8") as f:
            return Schema.from_json(f.read())

    def to_json(self) -> str:
        root: dict = {"schemaName": self.name}
        for f in self.fields:
            spec: dict = {"name": f.name, "dataType": f.kind}
            if not f.single:
                spec["singleValueField"] = False
            if f.default is not None:
                spec["defaultNullValue"] = f.default.decode() if isinstance(f.default, bytes) else f.default
            root.setdefault(_ROLES[f.role], []).append(spec)
        return json.dumps(root)

    def spark(self) -> T.StructType:
        """Role and default travel in each field's metadata."""
        text = lambda f: f.missing.decode() if isinstance(f.missing, bytes) else str(f.missing)
        return T.StructType([T.StructField(f.name, f.spark_type, False, {"role": f.role, "default": text(f)}) for f in self.fields])
