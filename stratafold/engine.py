"""The catalogue of tables below one folder."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

from stratafold import storage
from stratafold.crypto import CryptoError, FieldCipher, Keys
from stratafold.schema import Field, SchemaError, TableSchema
from stratafold.table import Table


class TableNotFoundError(KeyError):
    pass


class TableExistsError(ValueError):
    pass


@dataclass(frozen=True)
class TableMetadata:
    name: str
    schema: TableSchema
    key_type: str
    created_at: str
    state: str
    encrypted: bool
    folder: str = "data"


class Engine:
    """Named tables, each a folder with its log and a small description that is replaced by renames. Tables with encrypted
    fields need ``keys``."""

    def __init__(self, spark: SparkSession, root: str, keys: Keys | None = None):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self._handles: Counter[str] = Counter()

    def _path(self, name: str) -> str:
        if not name or not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith("."):
            raise SchemaError(f"{name!r} is no table name")
        return f"{self.root}/{name}"

    def _describe(self, name: str, schema: TableSchema, key_type: str, created: str, encrypted: bool, state: str = "READY", folder: str = "data") -> None:
        facts = {"schema": schema.to_json(), "key_type": key_type, "created_at": created, "encrypted": encrypted, "state": state, "folder": folder}
        storage.write_text(self.spark, f"{self._path(name)}/TABLE", json.dumps(facts))

    def table_metadata(self, name: str) -> TableMetadata:
        found = storage.read_text(self.spark, f"{self._path(name)}/TABLE")
        if found is None:
            raise TableNotFoundError(name)
        d = json.loads(found)
        return TableMetadata(name, TableSchema.from_json(d["schema"]), d["key_type"], d["created_at"], d["state"], d["encrypted"], d.get("folder", "data"))

    def create_table(self, name: str, schema: TableSchema, key_type: str = "string") -> Table:
        if storage.read_text(self.spark, f"{self._path(name)}/TABLE") is not None:
            raise TableExistsError(name)
        if self.keys is not None:
            schema = self._encrypting(schema, {})
        encrypted = any(f.encryption != "NONE" for f in schema.fields)
        self._describe(name, schema, key_type, dt.datetime.now(dt.timezone.utc).isoformat(), encrypted)
        return self.get_table(name)

    def create_encrypted_table(self, name: str, schema: TableSchema, schemes: dict[str, str], key_type: str = "string") -> Table:
        """A table some of whose fields are stored as ciphertexts."""
        return self.create_table(name, self._encrypting(schema, schemes), key_type)

    def _encrypting(self, schema: TableSchema, schemes: dict[str, str]) -> TableSchema:
        if self.keys is None:
            raise CryptoError("encrypted fields need keys")
        for field in schemes:
            schema.field(field)
        fields = tuple(Field(f.name, f.type, schemes.get(f.name, f.encryption)) for f in schema.fields)
        for f in fields:
            FieldCipher(f, self.keys)
        return TableSchema(schema.name, schema.version, fields, schema.max_depth)

    def enable_encryption(self, name: str, schemes: dict[str, str]) -> Table:
        """Encrypt fields of a table that are stored as they are: its rows are written anew and the old files deleted. There is
        no way back, and the scheme of a field that is encrypted already stays."""
        m = self.table_metadata(name)
        for field in schemes:
            if m.schema.field(field).encryption != "NONE":
                raise CryptoError(f"{field} is encrypted already")
        folder = f"data-{uuid.uuid4().hex}"
        schema = self._encrypting(m.schema, schemes)
        self.get_table(name).copied(f"{self._path(name)}/{folder}", schema)
        self._describe(name, schema, m.key_type, m.created_at, True, m.state, folder)
        storage.discard(self.spark, f"{self._path(name)}/{m.folder}")
        return self.get_table(name)

    def evolve_table(self, name: str, fields: tuple[Field, ...]) -> Table:
        """Append fields to a table's schema; rows written before have nulls there."""
        m = self.table_metadata(name)
        self._describe(name, m.schema.evolved(fields), m.key_type, m.created_at, m.encrypted or any(f.encryption != "NONE" for f in fields), m.state, m.folder)
        return self.get_table(name)

    def get_table(self, name: str) -> Table:
        m = self.table_metadata(name)
        if m.state != "READY":
            raise TableNotFoundError(f"{name} is {m.state}")
        self._handles[name] += 1
        return Table(self.spark, f"{self._path(name)}/{m.folder}", m.schema, m.key_type, self.keys)

    def register(self, name: str) -> None:
        """The table's present rows as a temporary view, for Spark SQL."""
        self.get_table(name).current().createOrReplaceTempView(name)

    def drop_table(self, name: str) -> None:
        m = self.table_metadata(name)
        self._describe(name, m.schema, m.key_type, m.created_at, m.encrypted, "DROPPED", m.folder)
        storage.discard(self.spark, self._path(name))
        self.spark.catalog.dropTempView(name)
        self._handles.pop(name, None)

    def list_tables(self) -> list[str]:
        place, fs = storage._hadoop(self.spark, self.root)
        if not fs.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory())
        return [n for n in names if (text := storage.read_text(self.spark, f"{self.root}/{n}/TABLE")) and json.loads(text)["state"] == "READY"]

    def metrics(self) -> dict:
        """Number of tables, and of handles given out for each."""
        return {"tables": len(self.list_tables()), "handles": dict(self._handles)}
