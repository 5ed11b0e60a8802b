"""Declared record types: fields, markers, and the lattice by which differing column types unify."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from .errors import QueryError, SchemaMismatch

OID, TID, DELETED, CID = "__oid__", "__tid__", "__deleted__", "__cid__"
SYSTEM = (OID, TID, DELETED, CID)
#: Label columns of protected types.
OWNER, GROUPS, READ_FLOOR, WRITE_FLOOR = "__owner__", "__groups__", "__read_floor__", "__write_floor__"
LABELS = {OWNER: "bigint", GROUPS: "array<bigint>", READ_FLOOR: "int", WRITE_FLOOR: "int"}
#: Labels of rows written before their type was protected. Fixed values of the permission model.
LEGACY_LABELS = {OWNER: 0, GROUPS: [0], READ_FLOOR: 0, WRITE_FLOOR: 500}
#: Struct that stands for a blob in its record.
BLOB = "struct<blob_oid:bigint,size:bigint,sha256:string>"


@dataclass(frozen=True)
class Field:
    """One field. type is a Spark DDL type; markers say how it may be asked for."""

    type: str
    index: bool = False
    unique: bool = False
    sorted: bool = False
    fulltext: str | bool = False
    renamed_from: str | None = None
    glue: Callable[[dict[str, Column]], Column] | None = None
    blob: bool = False
    ref: str | None = None
    default: Any = None
    required: bool = False

    @property
    def spark(self) -> T.DataType:
        return T._parse_datatype_string(BLOB if self.blob else self.type)

    def problems(self) -> list[str]:
        kind = self.type.strip().lower()
        listed = kind.startswith("array")
        inner = kind[6:-1] if listed else kind
        scalar = not inner.startswith(("array", "map", "struct", "binary"))
        marked = self.index or self.unique or self.sorted
        rules = [
            (self.index and not scalar, "an equality index needs a scalar or a list of scalars"),
            ((self.unique or self.sorted) and (listed or not scalar), "a unique or sorted field must be a scalar"),
            (bool(self.fulltext) and kind != "string", "full text needs a string"),
            (self.renamed_from is not None and marked, "a renamed field can't carry an index marker"),
            (self.glue is not None and (marked or self.renamed_from is not None), "a derived field can't carry an index marker or a rename"),
            (self.blob and (kind != "binary" or marked or self.fulltext or self.renamed_from or self.glue), "a blob is binary and carries no other marker"),
            (self.unique and self.default is not None, "a unique field's default must be null"),
        ]
        return [text for broken, text in rules if broken]


@dataclass(frozen=True)
class EntityType:
    """A record type: its name, its fields in order, and whether it is append-only or carries permission labels."""

    name: str
    fields: dict[str, Field]
    frozen: bool = False
    protected: bool = False
    actor: bool = field(default=False)

    def __post_init__(self) -> None:
        for name, f in self.fields.items():
            if name in SYSTEM or name in LABELS:
                raise SchemaMismatch(f"{self.name}.{name}: the name is reserved")
            for text in f.problems():
                raise SchemaMismatch(f"{self.name}.{name}: {text}")

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self.__dict__.get("fields", {}):
            raise QueryError(f"{self.__dict__.get('name')} has no field {name!r}")
        return fields(self)[name]

    def field(self, name: str) -> Field:
        if name == OID:
            return Field("bigint", unique=True)
        if self.protected and name in LABELS:
            return Field(LABELS[name])
        if name not in self.fields:
            raise QueryError(f"{self.name} has no field {name!r}")
        return self.fields[name]

    @property
    def columns(self) -> dict[str, str]:
        """Field names and DDL types as stored, labels included."""
        own = {n: BLOB if f.blob else f.type for n, f in self.fields.items()}
        return own | (LABELS if self.protected else {})

    @property
    def refs(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.ref]

    @property
    def uniques(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.unique]

    @property
    def struct(self) -> T.StructType:
        return T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in self.columns.items()))


class Fields:
    """`fields(Type).name` or `fields(Type)["name"]`: the left-hand side of a condition."""

    def __init__(self, entity: EntityType):
        object.__setattr__(self, "_entity", entity)

    def __getitem__(self, name: str):
        from .predicates import FieldRef

        self._entity.field(name)
        return FieldRef(self._entity, name)

    def __getattr__(self, name: str):
        return self[name]


def fields(entity: EntityType) -> Fields:
    return Fields(entity)


_RANK = {"boolean": 0, "tinyint": 1, "smallint": 1, "int": 1, "bigint": 1, "float": 2, "double": 2}


def unify(a: str, b: str) -> str:
    """The least type that holds both: void < all, boolean < integers < floats, lists element by element, else variant."""
    a, b = a.strip().lower(), b.strip().lower()
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    if a in _RANK and b in _RANK:
        return ("boolean", "bigint", "double")[max(_RANK[a], _RANK[b])]
    if a.startswith("array<") and b.startswith("array<"):
        return f"array<{unify(a[6:-1], b[6:-1])}>"
    return "variant"


def json_schema(entity: EntityType) -> dict:
    """The type as JSON Schema; references as integers, blobs as their descriptor."""

    def one(t: T.DataType) -> dict:
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": one(t.elementType)}
        if isinstance(t, T.MapType):
            return {"type": "object", "additionalProperties": one(t.valueType)}
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: one(f.dataType) for f in t.fields}}
        if isinstance(t, T.BooleanType):
            return {"type": "boolean"}
        if isinstance(t, T.IntegralType):
            return {"type": "integer"}
        if isinstance(t, T.NumericType):
            return {"type": "number"}
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return {"type": "string", "format": "date-time"}
        if isinstance(t, T.DateType):
            return {"type": "string", "format": "date"}
        return {"type": "string"}

    return {"title": entity.name, "type": "object", "properties": {f.name: one(f.dataType) for f in entity.struct.fields}}
