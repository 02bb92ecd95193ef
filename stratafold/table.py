"""Keyed document tables: a log of changes below a folder, read newest first.

Every mutation is one batch of the log, written aside and put in place by one rename whose name is its sequence
number; two writers that reach for the same number cannot both succeed. Compaction rewrites the log's rows up
to a batch as a base snapshot ordered by key. Fields that the schema declares encrypted are ciphertexts in every file,
indexes included. Indexes are kept beside the log, each with the batch that it covers; what came later is looked at
directly, so they never answer differently from a scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold import crypto, storage
from stratafold import predicate as P
from stratafold.functions import text
from stratafold.functions.vector import METRICS, InvertedFile, top_k
from stratafold.operators import versions
from stratafold.query import Query
from stratafold.schema import BoundedString, Primitive, SchemaError, TableSchema, VectorOf
from stratafold.sql import translator

#: Prefix of the columns that hold ciphertexts beside the values.
_CIPHER = "_cipher_"
INDEX_KINDS = ("EQUALITY", "RANGE", "UNIQUE", "FULL_TEXT", "VECTOR")


class DuplicateKeyError(ValueError):
    pass


class KeyNotFoundError(KeyError):
    pass


class UniqueViolationError(ValueError):
    pass


def check_index(schema: TableSchema, field: str, kind: str, metric: str | None = None) -> None:
    """Whether an index of this kind can be declared: it must suit the field's type and its encryption."""
    f = schema.field(field)
    scalar = isinstance(f.type, BoundedString) or (isinstance(f.type, Primitive) and f.type.name != "BOOLEAN")
    if kind not in INDEX_KINDS:
        raise SchemaError(f"unknown index {kind}")
    if kind in ("EQUALITY", "RANGE", "UNIQUE") and not scalar:
        raise SchemaError(f"{kind} index: {field} is {f.type}")
    if kind == "FULL_TEXT" and not (isinstance(f.type, BoundedString) or f.type == Primitive("STRING")):
        raise SchemaError(f"FULL_TEXT index: {field} is no text")
    if kind == "VECTOR" and (not isinstance(f.type, VectorOf) or metric not in METRICS):
        raise SchemaError(f"VECTOR index: {field} needs a vector type and a metric")
    need = {"EQUALITY": "equality", "UNIQUE": "equality", "RANGE": "range", "FULL_TEXT": "keyword", "VECTOR": "nearest"}[kind]
    if not crypto.supports(f.encryption, need):
        raise SchemaError(f"{kind} index: {field} is encrypted as {f.encryption}")


@dataclass(frozen=True)
class Index:
    """A declared index; ``covers`` is the batch up to which its folder holds the rows, 0 where nothing is stored."""

    field: str
    kind: str
    metric: str | None = None
    covers: int = 0
    folder: str | None = None
    analyser: str = "plain"

    def supports(self, p: P.Predicate) -> bool:
        """Whether the index can tell the rows that a leaf of a predicate selects."""
        if getattr(p, "field", None) != self.field:
            return False
        if isinstance(p, P.FullTextMatch):
            return self.kind == "FULL_TEXT" and not p.analyse
        if isinstance(p, P.VectorNearest):
            return self.kind == "VECTOR" and self.metric == p.metric
        if isinstance(p, P.Eq):
            return self.kind in ("EQUALITY", "RANGE", "UNIQUE")
        return isinstance(p, (P.Gt, P.Gte, P.Lt, P.Lte, P.Between)) and self.kind in ("RANGE", "UNIQUE")


class Table:
    """A table of documents under external keys, string or long. Encrypted fields need ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: TableSchema, key_type: str = "string", keys: crypto.Keys | None = None):
        if key_type not in ("string", "bigint"):
            raise SchemaError("keys are string or bigint")
        if schema.has("_key"):
            raise SchemaError("_key is the name of the key")
        self.spark, self.path, self.schema, self.key_type, self.keys = spark, path.rstrip("/"), schema, key_type, keys
        secret = [f for f in schema.fields if f.encryption != "NONE"]
        if secret and keys is None:
            raise crypto.CryptoError(f"{schema.name}: encrypted fields need keys")
        self.ciphers = {f.name: crypto.FieldCipher(f, keys) for f in secret}

    # -- indexes
    @property
    def indexes(self) -> list[Index]:
        """The declared indexes, the earliest first."""
        listed = storage.read_text(self.spark, f"{self.path}/INDEXES")
        return [Index(**d) for d in json.loads(listed)] if listed else []

    def _save(self, indexes: list[Index]) -> None:
        before = {i.folder for i in self.indexes if i.folder}
        storage.write_text(self.spark, f"{self.path}/INDEXES", json.dumps([asdict(i) for i in indexes]))
        for folder in before - {i.folder for i in indexes}:
            storage.discard(self.spark, f"{self.path}/{folder}")

    def create_index(self, field: str, kind: str, metric: str | None = None, analyser: str = "plain") -> None:
        """Declare an index and build it over the rows there are. It is kept with the table, and used by every handle.

        MATCH on a field with a FULL_TEXT index goes by the terms that its ``analyser`` makes of texts and of the term asked for.
        """
        check_index(self.schema, field, kind, metric)
        text.analyser(analyser)
        if kind == "UNIQUE" and not versions.unique_violations(self.current(), field).isEmpty():
            raise UniqueViolationError(f"{field} has repeated values")
        others = [i for i in self.indexes if (i.field, i.kind) != (field, kind)]
        self._save([*others, self._built(Index(field, kind, metric, analyser=analyser))])

    def drop_index(self, field: str, kind: str) -> None:
        self._save([i for i in self.indexes if (i.field, i.kind) != (field, kind)])

    def _built(self, index: Index) -> Index:
        """The index over all batches there are now."""
        top = self._top()
        if not top or (index.kind == "VECTOR" and index.field in self.ciphers):
            return replace(index, covers=0, folder=None)
        rows, folder = self._rows(), f"indexes/{index.field}-{index.kind}-{top:012d}-{uuid.uuid4().hex}"
        path = f"{self.path}/{folder}"
        if index.kind == "VECTOR":
            InvertedFile(rows.select("_key", index.field), "_key", index.field, index.metric).write(path)
            return replace(index, covers=top, folder=folder)
        if index.kind == "FULL_TEXT":
            terms = text.postings(rows, "_key", index.field, analyser=text.analyser(index.analyser)).select("term", "_key")
            if index.field in self.ciphers:
                terms = terms.select(crypto.keyword_token(F.col("term"), index.field, self.keys).alias("term"), "_key")
        else:
            stored = f"{_CIPHER}{index.field}" if index.field in self.ciphers else index.field
            terms = rows.select(F.col(stored).alias("term"), "_key").where("term IS NOT NULL")
        # a term of very many rows fills several partitions, since the key takes part in the ranges
        terms.repartitionByRange(storage.spread(rows, 64 << 20, 1), "term", "_key").sortWithinPartitions("term", "_key").write.parquet(path)
        return replace(index, covers=top, folder=folder)

    def _terms(self, index: Index) -> DataFrame:
        secret = index.field in self.ciphers
        kind = T.BinaryType() if secret and index.kind != "FULL_TEXT" else T.StringType() if index.kind == "FULL_TEXT" else self.schema.field(index.field).type.spark()
        return self.spark.read.schema(T.StructType([T.StructField("term", kind), T.StructField("_key", T._parse_datatype_string(self.key_type))])).parquet(f"{self.path}/{index.folder}")

    def index_for(self, p: P.Predicate) -> Index | None:
        """The first declared index that supports a leaf of a predicate and holds rows."""
        return next((i for i in self.indexes if i.supports(p) and (i.folder or i.field in self.ciphers)), None)

    def _lookup(self, p: P.Predicate) -> DataFrame | None:
        """The keys of the rows that a leaf selects, by an index; None where there is none."""
        index = self.index_for(p)
        if index is None:
            return None
        if index.kind == "VECTOR" and index.field in self.ciphers:
            near = self._rows().select("_key", self.ciphers[index.field].nearby(F.col(f"{_CIPHER}{index.field}")).alias(index.field))
            return top_k(near, "_key", index.field, p.query, p.top_k, p.metric).select("_key")
        later = self._rows(after=index.covers, keep_deletes=True)
        touched = later.select("_key") if later is not None else None
        live = later.where(F.col("_op") != versions.DELETE) if later is not None else None
        if index.kind == "VECTOR":
            best = InvertedFile.load(self.spark, f"{self.path}/{index.folder}").search(p.query, p.top_k, removed=touched)
            if live is not None:
                best = best.unionByName(top_k(live, "_key", index.field, p.query, p.top_k, p.metric)).orderBy(F.col("score").desc(), "_key").limit(p.top_k)
            return best.select("_key")
        terms = self._terms(index)
        if isinstance(p, P.FullTextMatch):
            term = F.lit(p.term) if index.analyser == "plain" else F.get(text.analyser(index.analyser)(F.lit(p.term)), 0)
            asked = [crypto.keyword_token(term, index.field, self.keys, v) for v in self.keys.versions] if index.field in self.ciphers else [term]
            hits = terms.where(F.col("term").isin(*asked))
        elif index.field in self.ciphers:
            hits = terms.where(P.on_ciphertext(p, self.ciphers[index.field], F.col("term")))
        else:
            hits = terms.withColumnRenamed("term", index.field).where(P.column(p, self.schema))
        hits = hits.select("_key")
        if later is None:
            return hits
        if isinstance(p, P.FullTextMatch):
            live = live.where(F.array_contains(text.analyser(index.analyser)(F.col(index.field)), term))
            return hits.join(touched, "_key", "left_anti").unionByName(live.select("_key"))
        return hits.join(touched, "_key", "left_anti").unionByName(live.where(P.column(p, self.schema, None, self._compared())).select("_key"))

    def _compared(self) -> dict[str, tuple[crypto.FieldCipher, str]]:
        return {name: (c, f"{_CIPHER}{name}") for name, c in self.ciphers.items()}

    # -- the log
    @property
    def _log_type(self) -> T.StructType:
        fields = [T.StructField("_key", T._parse_datatype_string(self.key_type), False), T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType())]
        return T.StructType(fields + [T.StructField(f.name, T.BinaryType()) if f.name in self.ciphers else f for f in self.schema.spark().fields])

    def _facts(self) -> dict:
        text = storage.read_text(self.spark, f"{self.path}/CURRENT")
        return json.loads(text) if text else {"base": 0, "next": 1}

    def _batches(self) -> list[int]:
        place, fs = storage._hadoop(self.spark, f"{self.path}/log")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))

    def _top(self) -> int:
        return max([self._facts()["base"], *self._batches()])

    def log(self) -> DataFrame:
        """All changes still kept: the base snapshot and the later batches, encrypted fields as their values."""
        return self._decrypted(self._read())

    def _read(self, after: int = 0, **options: str) -> DataFrame:
        facts = self._facts()
        paths = [f"{self.path}/log/batch-{n:012d}" for n in self._batches() if n > max(facts["base"], after)]
        if facts["base"] > after:
            paths.append(f"{self.path}/base-{facts['base']:012d}")
        if not paths:
            return self.spark.createDataFrame([], self._log_type)
        return self.spark.read.schema(self._log_type).options(**options).parquet(*paths)

    def _decrypted(self, stored: DataFrame) -> DataFrame:
        for name, cipher in self.ciphers.items():
            stored = stored.withColumn(name, cipher.decrypt(F.col(name)))
        return stored

    def _rows(self, after: int = 0, keep_deletes: bool = False) -> DataFrame | None:
        """The newest rows with their values and, beside them, the ciphertexts; with ``after`` those changed by later batches,
        None if there are none."""
        if after and after >= self._top():
            return None
        rows = versions.newest(self._read(after), keep_deletes=keep_deletes)
        for name in self.ciphers:
            rows = rows.withColumn(f"{_CIPHER}{name}", F.col(name))
        return self._decrypted(rows)

    def current(self) -> DataFrame:
        """The live rows: ``_key`` and the schema's fields."""
        return self._decrypted(versions.newest(self._read())).drop("_seq", "_op")

    def _stored(self, rows: DataFrame, number: int, operation: str) -> DataFrame:
        fields = [rows["_key"].cast(self.key_type).alias("_key"), F.lit(number).cast("bigint").alias("_seq"), F.lit(operation).alias("_op")]
        for f in self.schema.fields:
            value = (rows[f.name] if f.name in rows.columns else F.lit(None)).cast(f.type.spark())
            fields.append((self.ciphers[f.name].encrypt(value) if f.name in self.ciphers and f.name in rows.columns else value if f.name not in self.ciphers else F.lit(None).cast("binary")).alias(f.name))
        return rows.select(*fields)

    def _append(self, rows: DataFrame, operation: str) -> int:
        number = self._top() + 1
        staged = f"{self.path}/staged-{number:012d}-{uuid.uuid4().hex}"
        self._stored(rows, number, operation).write.parquet(staged)
        storage.rename(self.spark, staged, f"{self.path}/log/batch-{number:012d}")
        return number

    def _keyed(self, rows: DataFrame, scratch: storage.Scratch, there: bool) -> DataFrame:
        """A batch, checked: its keys are given, each once, and in the table already or not; one job tells all of it."""
        if "_key" not in rows.columns:
            raise SchemaError("rows need a _key")
        rows = scratch.keep(self.schema.checked(rows.withColumn("_key", F.col("_key").cast(self.key_type))), "batch")
        live = versions.newest(self._read().select("_key", "_seq", "_op")).select("_key", F.lit(True).alias("live"))
        each = rows.groupBy("_key").agg(F.count("*").alias("n")).join(live, "_key", "left")
        found = each.agg(F.count_if(F.col("_key").isNull()).alias("nulls"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if("live").alias("live"), F.count("*").alias("keys")).first()
        if found.nulls:
            raise SchemaError("a key is not null")
        if found.repeated:
            raise DuplicateKeyError("a batch has a key once")
        if not there and found.live:
            raise DuplicateKeyError(f"{self.schema.name}: a key is there already")
        if there and found.live < found["keys"]:
            raise KeyNotFoundError(f"{self.schema.name}: a key is not there")
        return rows

    def _check_unique(self, rows: DataFrame) -> None:
        """Compare the values of a batch with the index and with what changed after it; other rows of the table are not read."""
        for index in self.indexes:
            if index.kind != "UNIQUE":
                continue
            name = index.field
            values = rows.select(F.col(name).alias("term"), "_key").where("term IS NOT NULL")
            if not versions.unique_violations(values, "term").isEmpty():
                raise UniqueViolationError(f"{name} has repeated values in a batch")
            later = self._rows(after=index.covers, keep_deletes=True)
            mine, taken = rows.select("_key"), []
            if later is not None:
                live = later.where(F.col("_op") != versions.DELETE).select(F.col(name).alias("term"), "_key")
                taken.append(live.join(values.select("term"), "term", "left_semi"))
            if index.folder:
                asked = values.select("term")
                if name in self.ciphers:
                    asked = values.select(F.explode(F.array(*[self.ciphers[name].encrypt(F.col("term"), v) for v in self.keys.versions])).alias("term"))
                hits = self._terms(index).join(asked, "term", "left_semi")
                taken.append(hits.join(later.select("_key"), "_key", "left_anti") if later is not None else hits)
            if any(not t.select("_key").join(mine, "_key", "left_anti").isEmpty() for t in taken):
                raise UniqueViolationError(f"{name} would have repeated values")

    # -- mutations; each returns the sequence number of its batch
    def create(self, rows: DataFrame) -> int:
        """Add rows whose keys must be new."""
        scratch = storage.Scratch(self.spark, "table")
        try:
            rows = self._keyed(rows, scratch, False)
            self._check_unique(rows)
            return self._append(rows, versions.PUT)
        finally:
            scratch.clear()

    def insert(self, rows: DataFrame) -> int:
        """``create`` with the first field, a string that is not null, as the key."""
        first = self.schema.fields[0] if self.schema.fields else None
        if first is None or not (isinstance(first.type, BoundedString) or first.type == Primitive("STRING")):
            raise SchemaError("insert needs a text as first field")
        return self.create(rows.withColumn("_key", F.col(first.name)))

    def update(self, rows: DataFrame, mode: str = "REPLACE") -> int:
        """Change rows whose keys must exist. REPLACE takes the new row as it is, PATCH fills its nulls from the old one."""
        if mode not in ("REPLACE", "PATCH"):
            raise ValueError(f"unknown mode {mode}")
        scratch = storage.Scratch(self.spark, "table")
        try:
            rows = self._keyed(rows, scratch, True)
            if mode == "PATCH":
                rows = scratch.keep(versions.patch(self.current(), rows), "patch")
            self._check_unique(rows)
            return self._append(rows, versions.PUT)
        finally:
            scratch.clear()

    def delete(self, keys: DataFrame) -> int:
        """Remove keys, whether or not they are there."""
        return self._append(keys.select("_key").distinct(), versions.DELETE)

    # -- reads
    def get(self, key: Any) -> DataFrame:
        """The row of a key; only the log's rows of that key are resolved."""
        return self._decrypted(versions.newest(self._read().where(F.col("_key") == F.lit(key)))).drop("_seq", "_op")

    def scan(self, low: Any = None, high: Any = None) -> DataFrame:
        """The rows of [low, high) in key order."""
        return self._decrypted(versions.newest(self._read().where(versions.in_range(F.col("_key"), low, high)))).drop("_seq", "_op").orderBy("_key")

    def select(self, p: P.Predicate) -> DataFrame:
        """The rows that match. Leaves that a declared index supports are told by it, comparisons of encrypted fields that their
        scheme allows by the ciphertexts, others by the values."""
        P.check(p, self.schema)
        found = {leaf: keys for leaf in P.leaves(p) if (keys := self._lookup(leaf)) is not None}
        return P.select(self._rows(), p, self.schema, "_key", found, self._compared()).select("_key", *self.schema.names)

    def query(self) -> Query:
        return Query(self.current(), self.schema, "_key", self.select)

    def sql(self, statement: str, parameters: Sequence[Any] = (), strict: bool = True) -> DataFrame:
        return translator.execute(statement, self.current(), self.schema, parameters, strict, run=self.select)

    def recovered(self) -> DataFrame:
        """The live rows of what can still be read, damaged files passed over; other reads fail on damage."""
        return self._decrypted(versions.newest(self._read(ignoreCorruptFiles="true"))).drop("_seq", "_op")

    def changes_since(self, sequence: int) -> DataFrame:
        """The changes after a batch in the order of the log, for replay."""
        return self.log().where(F.col("_seq") > sequence).orderBy("_seq", "_key")

    # -- maintenance
    def compact(self, rows_per_file: int = 4_000_000, compression: str = "zstd", bloom: tuple[str, ...] = ("_key",), rekey: bool = False) -> int:
        """Rewrite everything so far as a snapshot without deleted keys, ordered by key; older folders are dropped and the
        indexes built anew.

        ``compression`` is none, gzip (deflate) or zstd. Row groups carry Bloom filters of the columns in ``bloom`` and of those
        with an index for equality, so that a point read passes over those that cannot hold its key. ``rekey`` encrypts anew under
        the current key version.
        """
        done, before = self._batches(), self._facts()["base"]
        top = max([before, *done])
        if not top or (top == before and not rekey):
            return top
        base = f"base-{top:012d}"
        rows = versions.newest(self._read())
        if rekey:
            for name, cipher in self.ciphers.items():
                rows = rows.withColumn(name, cipher.encrypt(cipher.decrypt(F.col(name))))
            if top == before:
                # a batch that changes nothing gives the snapshot a number of its own
                top = self._append(rows.select("_key").limit(0), versions.DELETE)
                done, base = self._batches(), f"base-{top:012d}"
        self._write_base(rows, f"{self.path}/{base}", rows_per_file, compression, bloom)
        storage.write_text(self.spark, f"{self.path}/CURRENT", json.dumps({"base": top}))
        for n in done:
            if n <= top:
                storage.discard(self.spark, f"{self.path}/log/batch-{n:012d}")
        if before:
            storage.discard(self.spark, f"{self.path}/base-{before:012d}")
        if self.indexes:
            self._save([self._built(i) for i in self.indexes])
        return top

    def _write_base(self, rows: DataFrame, path: str, rows_per_file: int = 4_000_000, compression: str = "zstd", bloom: tuple[str, ...] = ("_key",)) -> None:
        columns = dict.fromkeys([*bloom, *(i.field for i in self.indexes if i.kind in ("EQUALITY", "UNIQUE"))])
        n = storage.spread(rows, 128 << 20, 1)
        rows.repartitionByRange(n, "_key").sortWithinPartitions("_key").write.mode("overwrite").options(
            maxRecordsPerFile=rows_per_file, compression=compression, **{f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
        ).parquet(path)

    def copied(self, path: str, schema: TableSchema) -> Table:
        """The live rows as a new table under ``path`` whose schema declares other encryption, with the same indexes."""
        other = Table(self.spark, path, schema, self.key_type, self.keys)
        for i in self.indexes:
            check_index(schema, i.field, i.kind, i.metric)
        top = max(1, self._top())
        other._write_base(other._stored(self.current(), top, versions.PUT), f"{other.path}/base-{top:012d}")
        storage.write_text(self.spark, f"{other.path}/CURRENT", json.dumps({"base": top}))
        if self.indexes:
            other._save([other._built(replace(i, covers=0, folder=None)) for i in self.indexes])
        return other
