"""Field-level encryption that keeps as much of search as its scheme allows.

Keys come from a provider and never enter a column. Deterministic fields use AES-GCM with an initialisation vector
derived from key, field and value: equal values give equal bytes, which equality and keyword lookups need (a
synthetic-vector scheme of this package's own, not RFC 5297). Opaque fields use AES-GCM with random vectors.
Order-preserving fields go through a seeded increasing table, keyword search through keyed hashes of terms, vectors through
a keyed scaling with seeded noise. Every ciphertext carries the version of its key in the first four bytes and a tag that
tells changed bytes: of AES-GCM, or the first 16 bytes of a keyed hash.

Layouts, in bytes: version 4, vector 12, text, tag 16 (deterministic, opaque); version 4, value 8, length 1, tag 16
(order-preserving; binary order is the order of values); version 4, seed 8, 4 for each coordinate, tag 16 (distance-preserving).
"""

from __future__ import annotations

import hashlib
import hmac
import math
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions import text
from stratafold.schema import ArrayOf, BoundedString, Field, ObjectOf, Primitive, VectorOf

# What can be done with a field under each scheme.
CAPABILITIES = {
    "NONE": {"equality", "range", "keyword", "phrase", "sse", "nearest"},
    "DETERMINISTIC": {"equality", "keyword"},
    "ORDER_PRESERVING": {"equality", "range"},
    "DISTANCE_PRESERVING": {"nearest"},
    "OPAQUE": set(),
}
# Bytes of a ciphertext by scheme (least, or exact with 4 more a dimension for vectors).
DETERMINISTIC_LEAST, OPAQUE_LEAST, ORDER_EXACT, DISTANCE_FIXED = 20, 32, 29, 28
ORDER_DOMAIN_BYTES = 2


class CryptoError(ValueError):
    pass


def supports(scheme: str, operation: str) -> bool:
    if scheme not in CAPABILITIES:
        raise CryptoError(f"unknown scheme {scheme}")
    return operation in CAPABILITIES[scheme]


class KeyProvider:
    """Where master keys come from, such as a key management service: subclasses say which versions there are and give their bytes."""

    def versions(self) -> list[int]:
        raise NotImplementedError

    def key(self, version: int) -> bytes:
        raise NotImplementedError


class Keys:
    """Versions of a master key, and the keys derived from them for each field and purpose."""

    def __init__(self, versions: dict[int, bytes] | KeyProvider, current: int | None = None):
        if isinstance(versions, KeyProvider):
            versions = {v: versions.key(v) for v in versions.versions()}
        if not versions or any(v < 1 for v in versions) or any(len(k) < 16 for k in versions.values()):
            raise CryptoError("key versions begin at 1, and a key has 16 bytes or more")
        self.versions, self.current = dict(versions), current or max(versions)
        if self.current not in self.versions:
            raise CryptoError(f"no key of version {self.current}")

    def rotated(self, key: bytes) -> Keys:
        """These keys with a further version, which is the current one."""
        version = max(self.versions) + 1
        return Keys(self.versions | {version: key}, version)

    def pruned(self, in_use: set[int]) -> Keys:
        """These keys without the versions that no ciphertext names; the current one stays."""
        if missing := in_use - set(self.versions):
            raise CryptoError(f"no keys of versions {sorted(missing)}")
        return Keys({v: k for v, k in self.versions.items() if v in in_use or v == self.current}, self.current)

    def derived(self, field: str, purpose: str, version: int | None = None) -> bytes:
        version = version or self.current
        if version not in self.versions:
            raise CryptoError(f"no key of version {version}")
        # extract and expand of RFC 5869 with one block of output
        seed = hmac.new(b"stratafold", self.versions[version], hashlib.sha256).digest()
        return hmac.new(seed, f"{purpose}/{field}/{version}".encode() + b"\x01", hashlib.sha256).digest()


def _prefixed(body: Column, version: int) -> Column:
    return F.concat(F.unhex(F.lit(f"{version:08x}")), body)


def version_of(cipher: Column) -> Column:
    """The key version that a ciphertext names; null for what is too short or names none."""
    v = F.conv(F.hex(F.substring(cipher, 1, 4)), 16, 10).cast("bigint")
    return F.when((F.octet_length(cipher) > 4) & (v > 0) & (v < 2**31), v.cast("int"))


def deterministic(value: Column, field: str, keys: Keys, version: int | None = None) -> Column:
    """Equal values of a field give equal bytes; bound to the field's name. Null stays null."""
    version = version or keys.current
    key, mac = F.lit(keys.derived(field, "deterministic", version)), keys.derived(field, "vector", version).hex()
    plain = value.cast("string")
    vector = F.substring(F.unhex(F.sha2(F.concat(F.lit(mac), F.sha2(F.concat(F.lit(mac), plain), 256)), 256)), 1, 12)
    return _prefixed(F.call_function("aes_encrypt", plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), vector, F.lit(field.encode())), version)


def opaque(value: Column, field: str, keys: Keys, version: int | None = None) -> Column:
    """Different bytes each time; bound to the field's name. Null stays null."""
    version = version or keys.current
    key = F.lit(keys.derived(field, "opaque", version))
    return _prefixed(F.call_function("aes_encrypt", value.cast("string").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(field.encode())), version)


def decrypt(cipher: Column, field: str, keys: Keys, scheme: str) -> Column:
    """The text of a deterministic or opaque ciphertext under the key version it names; null where that key is
    unknown, the field is another, or bytes were changed."""
    if scheme not in ("DETERMINISTIC", "OPAQUE"):
        raise CryptoError(f"{scheme} fields are not decrypted here")
    out = F.lit(None).cast("binary")
    body = F.substring(cipher, 5, 2**31 - 1)
    for v in keys.versions:
        key = F.lit(keys.derived(field, scheme.lower(), v))
        out = F.when(version_of(cipher) == v, F.call_function("try_aes_decrypt", body, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(field.encode()))).otherwise(out)
    return out.cast("string")


def rekey(df: DataFrame, columns: dict[str, str | FieldCipher], keys: Keys) -> DataFrame:
    """Encrypt the columns anew under the current key version. A column is named with its scheme, for texts, or with its cipher."""
    for name, how in columns.items():
        cipher = how if isinstance(how, FieldCipher) else FieldCipher(Field(name, Primitive("STRING"), how), keys)
        df = df.withColumn(name, cipher.encrypt(cipher.decrypt(F.col(name))))
    return df


def valid_length(cipher: Column, scheme: str, dimensions: int = 0) -> Column:
    """Whether bytes given as already encrypted have a length that the scheme can give."""
    n = F.octet_length(cipher)
    return {"DETERMINISTIC": n >= DETERMINISTIC_LEAST, "OPAQUE": n >= OPAQUE_LEAST, "ORDER_PRESERVING": n == ORDER_EXACT, "DISTANCE_PRESERVING": n == DISTANCE_FIXED + 4 * dimensions, "NONE": F.lit(False)}[scheme]


class OrderPreserving:
    """A seeded strictly increasing table over the values of one or two bytes, ten times as wide as its domain.

    Whole numbers of 8 or 16 bits have their sign flipped, texts of at most ``max_bytes`` bytes are padded with zeros, so
    that the order of ciphertexts is that of values. The table has at most 65,536 entries.
    """

    def __init__(self, keys: Keys, field: str, kind: str, max_bytes: int = ORDER_DOMAIN_BYTES):
        if kind not in ("INT8", "INT16", "STRING"):
            raise CryptoError("order is preserved for INT8, INT16 and short strings")
        if kind == "STRING" and not 1 <= max_bytes <= ORDER_DOMAIN_BYTES:
            raise CryptoError(f"order is preserved for strings of up to {ORDER_DOMAIN_BYTES} bytes")
        self.kind, self.bytes = kind, {"INT8": 1, "INT16": 2}.get(kind, max_bytes)
        domain = 256**self.bytes
        seed = int.from_bytes(keys.derived(field, "order"), "big")
        self.table = np.sort(np.random.default_rng(seed).choice(10 * domain, size=domain, replace=False)).astype(np.int64) + 1

    def position(self, value: int | str) -> int:
        if self.kind == "STRING":
            raw = value.encode()
            if len(raw) > self.bytes:
                raise CryptoError(f"{value!r} is longer than {self.bytes} bytes")
            return int.from_bytes(raw.ljust(self.bytes, b"\0"), "big")
        half = 128 if self.kind == "INT8" else 32768
        if not -half <= value < half:
            raise CryptoError(f"{value} is out of range")
        return value + half

    def bound(self, value: int | float | str, low: bool, strict: bool) -> int:
        """The least (``low``) or greatest ciphertext of the values on the allowed side of a bound, which may lie outside
        the domain or between its values; 0 or one beyond the table where there are none below or above."""
        if self.kind == "STRING":
            raw = value.encode()
            padded, exact = raw[: self.bytes].ljust(self.bytes, b"\0"), len(raw) <= self.bytes
            at = int.from_bytes(padded, "big")
            # a longer bound lies just after its first bytes
            first, last = at + (strict or not exact), at - (strict and exact)
        else:
            half, whole = 128 if self.kind == "INT8" else 32768, math.floor(value)
            exact = whole == value
            first, last = whole + half + (strict or not exact), whole + half - (strict and exact)
        if low:
            return int(self.table[max(first, 0)]) if first < len(self.table) else int(self.table[-1]) + 1
        return int(self.table[min(last, len(self.table) - 1)]) if last >= 0 else 0

    def encrypt_value(self, value: int | str) -> int:
        """Ciphertext of a bound of a range, for comparison with the column."""
        return int(self.table[self.position(value)])

    def encrypt(self, column: Column) -> Column:
        table, position, kind = self.table, self.position, self.kind

        @F.pandas_udf("bigint")
        def run(s: pd.Series) -> pd.Series:
            there = s.notna().to_numpy()
            values = s[there].tolist() if kind == "STRING" else s[there].astype("int64").tolist()
            out = pd.Series([None] * len(s), dtype="Int64")
            out[there] = table[[position(v) for v in values]]
            return out

        return run(column.cast("string") if kind == "STRING" else column.cast("bigint"))

    def _positions(self, values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        plain = values.fillna(0).to_numpy(dtype=np.int64)
        at = np.minimum(np.searchsorted(self.table, plain), len(self.table) - 1)
        return at, (self.table[at] == plain) & values.notna().to_numpy()

    def decrypt(self, column: Column) -> Column:
        """The whole number behind a ciphertext; null for what the table does not hold. Texts need their lengths: ``restore``."""
        if self.kind == "STRING":
            raise CryptoError("texts are decrypted with their lengths")
        return self.restore(column, F.lit(0)).cast("bigint")

    def restore(self, column: Column, length: Column) -> Column:
        """The value behind a ciphertext, as text; of a text its first ``length`` bytes."""
        positions, half, width, text = self._positions, 128 if self.kind == "INT8" else 32768, self.bytes, self.kind == "STRING"

        @F.pandas_udf("string")
        def run(s: pd.Series, n: pd.Series) -> pd.Series:
            at, there = positions(s)
            made = [(int(p).to_bytes(width, "big")[: int(k)].decode("utf-8", "replace") if text else str(int(p) - half)) if ok else None for p, ok, k in zip(at, there, n.fillna(0), strict=True)]
            return pd.Series(made, dtype=object)

        return run(column, length)


def keyed_hash(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of bytes, put together from plain hashes, in hexadecimal digits."""
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(k ^ x for k in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), value), 256))), 256)


def _tag(body: Column, field: str, keys: Keys, version: int) -> Column:
    return F.substring(F.unhex(keyed_hash(body, keys.derived(field, "tag", version))), 1, 16)


def keyword_token(term: Column, field: str, keys: Keys, version: int | None = None) -> Column:
    """Keyed hash of a term of a field, in hexadecimal digits."""
    return keyed_hash(term.cast("binary"), keys.derived(field, "keyword", version))


def keyword_index(df: DataFrame, key: str, field: str, keys: Keys) -> DataFrame:
    """(token, key): the postings of a field with its terms hashed."""
    return text.postings(df, key, field).select(keyword_token(F.col("term"), field, keys).alias("token"), key)


def keyword_search(index: DataFrame, term: str, field: str, keys: Keys) -> DataFrame:
    """The keys of the rows with a term; the index sees only its hash."""
    token = hmac.new(keys.derived(field, "keyword"), term.encode(), hashlib.sha256).hexdigest()
    return index.where(F.col("token") == token).drop("token")


#: Spread of the scaling of vectors and of their noise, as a part of the scaling.
SCALE, NOISE = 4.0, 0.01


def scaling(field: str, keys: Keys, version: int | None = None) -> float:
    """The factor that the vectors of a field are multiplied by."""
    return SCALE * (1 + int.from_bytes(keys.derived(field, "distance", version)[:4], "big") / 2**32)


def _noise(seeds: np.ndarray, d: int, key: bytes, most: float) -> np.ndarray:
    """For each seed a direction and a length up to ``most`` that only the key and the seed determine."""
    base = np.uint64(int.from_bytes(key[:8], "big"))
    x = (seeds[:, None] ^ base) + np.arange(1, 2 * d + 2, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
    normal = np.sqrt(-2 * np.log(1 - u[:, :d])) * np.cos(2 * np.pi * u[:, d : 2 * d])
    return normal * (most * u[:, -1:] / np.maximum(np.sqrt((normal**2).sum(axis=1, keepdims=True)), 1e-30))


def _blur_body(vector: Column, field: str, keys: Keys, version: int) -> Column:
    """Seed and scaled, shifted coordinates of each vector as bytes; null for null."""
    key, factor = keys.derived(field, "distance", version), scaling(field, keys, version)

    @F.arrow_udf(T.BinaryType())
    def run(a: pa.Array) -> pa.Array:
        out: list[bytes | None] = [None] * len(a)
        sizes = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == d)
            x = a.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)
            seeds = np.random.default_rng().integers(0, 2**64, size=len(at), dtype=np.uint64)
            made = (factor * x + _noise(seeds, int(d), key, NOISE * factor)).astype("<f4")
            for i, seed, row in zip(at, seeds.astype("<u8"), made, strict=True):
                out[i] = seed.tobytes() + row.tobytes()
        return pa.array(out, type=pa.binary())

    return run(vector)


def _blurred_vectors(body: Column, key: bytes | None, factor: float) -> Column:
    """The vectors in the bytes of ``_blur_body`` scaled back, with the noise taken out if the key is given."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(a: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = [None] * len(a)
        sizes = pc.fill_null(pc.binary_length(a), -1).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes[(sizes >= 8) & (sizes % 4 == 0)]):
            at = np.flatnonzero(sizes == n)
            raw = np.frombuffer(b"".join(a.take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), n)
            x = np.ascontiguousarray(raw[:, 8:]).view("<f4").astype(np.float64)
            if key is not None:
                x = x - _noise(np.ascontiguousarray(raw[:, :8]).view("<u8")[:, 0], x.shape[1], key, NOISE * factor)
            for i, row in zip(at, (x / factor).astype(np.float32), strict=True):
                out[i] = row
        return pa.array(out, type=pa.list_(pa.float32()))

    return run(body)


class FieldCipher:
    """Encryption and decryption of one field under its scheme, and the comparisons that its ciphertexts allow."""

    def __init__(self, field: Field, keys: Keys):
        self.field, self.keys, self.scheme = field, keys, field.encryption
        if self.scheme not in CAPABILITIES:
            raise CryptoError(f"unknown scheme {self.scheme}")
        kind = field.type
        if self.scheme == "DISTANCE_PRESERVING" and not isinstance(kind, VectorOf):
            raise CryptoError(f"{field.name}: distances are preserved for vectors")
        self._tables: dict[int, OrderPreserving] = {}
        if self.scheme == "ORDER_PRESERVING":
            if not (kind in (Primitive("INT8"), Primitive("INT16")) or isinstance(kind, BoundedString) and kind.max_bytes <= ORDER_DOMAIN_BYTES):
                raise CryptoError(f"{field.name}: order is preserved for INT8, INT16 and strings of up to {ORDER_DOMAIN_BYTES} bytes")

    def _table(self, version: int) -> OrderPreserving:
        kind = self.field.type
        if version not in self._tables:
            text = isinstance(kind, BoundedString)
            self._tables[version] = OrderPreserving(Keys(self.keys.versions, version), self.field.name, "STRING" if text else kind.name, kind.max_bytes if text else ORDER_DOMAIN_BYTES)
        return self._tables[version]

    def _text(self, value: Column) -> Column:
        return F.to_json(value) if isinstance(self.field.type, (ArrayOf, ObjectOf, VectorOf)) else value.cast("string")

    def encrypt(self, value: Column, version: int | None = None) -> Column:
        """The ciphertext of a column of the field's type; null stays null."""
        name, version = self.field.name, version or self.keys.current
        if self.scheme == "NONE":
            return value
        if self.scheme in ("DETERMINISTIC", "OPAQUE"):
            return (deterministic if self.scheme == "DETERMINISTIC" else opaque)(self._text(value), name, self.keys, version)
        if self.scheme == "ORDER_PRESERVING":
            length = F.octet_length(value.cast("string")) if isinstance(self.field.type, BoundedString) else F.lit(0)
            body = F.concat(F.unhex(F.lpad(F.hex(self._table(version).encrypt(value)), 16, "0")), F.unhex(F.lpad(F.hex(length.cast("bigint")), 2, "0")))
        else:
            body = _blur_body(value, name, self.keys, version)
        whole = _prefixed(body, version)
        return F.concat(whole, _tag(whole, name, self.keys, version))

    def decrypt(self, cipher: Column) -> Column:
        """The value of a ciphertext under the key version it names; null where that key is unknown, the field is another, or
        bytes were changed. Vectors come back to within single precision of the scaling."""
        name, kind = self.field.name, self.field.type
        if self.scheme == "NONE":
            return cipher
        if self.scheme in ("DETERMINISTIC", "OPAQUE"):
            text = decrypt(cipher, name, self.keys, self.scheme)
            return F.from_json(text, kind.spark()) if isinstance(kind, (ArrayOf, ObjectOf, VectorOf)) else text.cast(kind.spark())
        out = F.lit(None).cast(kind.spark())
        size = F.octet_length(cipher)
        whole = F.substring(cipher, F.lit(1), F.greatest(size - 16, F.lit(0)))
        for v in self.keys.versions:
            body = F.substring(cipher, F.lit(5), F.greatest(size - 20, F.lit(0)))
            good = (version_of(cipher) == v) & (_tag(whole, name, self.keys, v) == F.substring(cipher, F.greatest(size - 15, F.lit(1)), F.lit(16)))
            if self.scheme == "ORDER_PRESERVING":
                number = F.conv(F.hex(F.substring(body, 1, 8)), 16, 10).cast("bigint")
                length = F.conv(F.hex(F.substring(body, 9, 1)), 16, 10).cast("int")
                plain = self._table(v).restore(number, length).cast(kind.spark())
            else:
                plain = _blurred_vectors(body, self.keys.derived(name, "distance", v), scaling(name, self.keys, v))
            out = F.when(good, plain).otherwise(out)
        return out

    def nearby(self, cipher: Column) -> Column:
        """Vectors whose nearest neighbours are approximately those of the plain ones, without taking out the noise."""
        out = F.lit(None).cast("array<float>")
        body = F.substring(cipher, F.lit(5), F.greatest(F.octet_length(cipher) - 20, F.lit(0)))
        for v in self.keys.versions:
            out = F.when(version_of(cipher) == v, _blurred_vectors(body, None, scaling(self.field.name, self.keys, v))).otherwise(out)
        return out

    def equal(self, cipher: Column, value: Any) -> Column | None:
        """Whether ciphertexts stand for a value, told from the ciphertexts alone; None where the scheme does not allow it."""
        typed = F.lit(value).cast(self.field.type.spark())
        if self.scheme == "DETERMINISTIC":
            return cipher.isin(*[deterministic(self._text(typed), self.field.name, self.keys, v) for v in self.keys.versions])
        if self.scheme != "ORDER_PRESERVING":
            return None
        same = self.between(cipher, value, value)
        # padding makes texts equal that differ in NULs at the end only
        return same & (F.conv(F.hex(F.substring(cipher, 13, 1)), 16, 10) == str(len(value.encode()))) if isinstance(value, str) else same

    def between(self, cipher: Column, low: Any = None, high: Any = None, open_low: bool = False, open_high: bool = False) -> Column | None:
        """Whether ciphertexts stand for values of a range; null ends are open."""
        if self.scheme != "ORDER_PRESERVING":
            return None
        out, part = F.lit(False), F.substring(cipher, 5, 8)
        for v in self.keys.versions:
            table, one = self._table(v), version_of(cipher) == v
            for end, is_low, strict in ((low, True, open_low), (high, False, open_high)):
                if end is None:
                    continue
                at = table.bound(end, is_low, strict)
                one = one & (part >= F.lit(at.to_bytes(8, "big")) if is_low else part <= F.lit(at.to_bytes(8, "big")))
            out = out | one
        return F.when(cipher.isNotNull(), out)


def encrypt_fields(df: DataFrame, schemes: dict[str, str], keys: Keys) -> DataFrame:
    """The text columns of ``schemes`` encrypted in place; NONE leaves them. Other types: ``FieldCipher``."""
    for name, scheme in schemes.items():
        if scheme not in ("DETERMINISTIC", "OPAQUE", "NONE"):
            raise CryptoError(f"{scheme}: use a FieldCipher, which knows the field's type")
        df = df.withColumn(name, FieldCipher(Field(name, Primitive("STRING"), scheme), keys).encrypt(F.col(name).cast("string") if scheme != "NONE" else F.col(name)))
    return df
