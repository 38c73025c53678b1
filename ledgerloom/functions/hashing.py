"""Content, record and signature hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, StructType

from ledgerloom.functions.numbers import fixed

# The order in which record fields enter their hash.
LINEAGE_HASH_FIELDS = (
    "tx_id", "job_id", "timestamp", "input_dataset_ids", "input_hashes",
    "output_dataset_id", "output_hash", "transformation_type", "pipeline_id",
    "pipeline_version", "sigma_level", "classification", "jurisdictions",
    "owner_org", "operator_msp", "node_id", "region", "ipfs_cid",
)
MEASUREMENT_HASH_FIELDS = (
    "pipeline_id", "dataset_id", "run_id", "timestamp", "sigma_level",
    "records_processed", "records_failed", "node_id", "region",
)
DNA_HASH_FIELDS = (
    "classification", "content_hash", "created_at", "creator_id", "dataset_id",
    "fabric_tx_id", "ipfs_cid", "jurisdictions", "parent_ids", "quality_sigma",
    "transformation",
)
ARRAY_FIELDS = {"input_dataset_ids", "input_hashes", "jurisdictions", "parent_ids"}


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def content_cid(content_hash: Column) -> Column:
    return F.concat(F.lit("Qm"), F.left(sha256(content_hash), F.lit(44)))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def piped(*parts: Column) -> Column:
    """Join with ``|``; ``concat_ws`` alone would skip nulls, so they become empty text."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _field(name: str) -> Column:
    if name in ARRAY_FIELDS:
        return F.array_join(F.col(name), ",")
    if name == "sigma_level":
        return fixed(F.col(name), 4)
    return F.col(name)


def lineage_hash() -> Column:
    """Tamper hash of a lineage row; operator code and the stored hash are not covered."""
    return sha256(piped(*[_field(name) for name in LINEAGE_HASH_FIELDS]))


def measurement_hash() -> Column:
    return sha256(piped(*[_field(name) for name in MEASUREMENT_HASH_FIELDS]))


def run_fingerprint(pipeline_id: Column, run_id: Column, row_count: Column) -> Column:
    """Names a run by its row count; says nothing about the content of the rows."""
    return sha256(piped(pipeline_id, run_id, row_count))


def _tagged(name: str, kind: DataType) -> Column:
    """A field as type letter, bytes, ``:`` and text, so no value can run into the next; null is the letter and ``-``."""
    value, simple = F.col(name), kind.simpleString()
    if simple in ("tinyint", "smallint", "int", "bigint"):
        tag, text = "i", value.cast("string")
    elif simple in ("float", "double") or simple.startswith("decimal"):
        tag, text = "n", value.cast("decimal(38,6)").cast("string")
    elif simple in ("timestamp", "timestamp_ntz"):
        tag, text = "t", F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif simple == "boolean":
        tag, text = "b", value.cast("string")
    elif simple == "date":
        tag, text = "d", value.cast("string")
    elif simple == "string":
        tag, text = "s", value
    else:
        tag, text = "j", F.to_json(F.struct(value))
    size = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(F.lit(tag), size, F.lit(":"), text), F.lit(f"{tag}-"))


def row_hash(schema: StructType) -> Column:
    """Hash of all fields of a row by type and value; numbers with a fraction count to six decimals."""
    return sha256(F.concat(*[_tagged(f.name, f.dataType) for f in schema]))


#: Parts of a row's hash that are summed, and hexadecimal digits of each.
DIGEST_LANES, DIGEST_DIGITS = 4, 15


def table_digest(schema: StructType) -> Column:
    """Aggregate over all columns of all rows that does not depend on their order.

    Each row's hash is cut into four numbers of 60 bits, which are summed over the rows; the digest is the
    hash of the sums and the number of rows. A row more, less or twice, a changed field or a value that
    moves to its neighbour gives another digest. Sums are exact up to 10**20 rows.
    """
    row = row_hash(schema)
    sums = []
    for lane in range(DIGEST_LANES):
        digits = F.substring(row, lane * DIGEST_DIGITS + 1, DIGEST_DIGITS)
        sums.append(F.sum(F.conv(digits, 16, 10).cast("decimal(38,0)")).cast("string"))
    return sha256(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums))


def sign(payload: Column, key: Column) -> Column:
    return sha256(F.concat(payload, key))


def verify(payload: Column, key: Column, signature: Column) -> Column:
    """False, not unknown, where anything is missing."""
    return F.coalesce(sign(payload, key) == signature, F.lit(False))


def json_string(value: Column) -> Column:
    """JSON text literal with everything outside printable ASCII as ``\\uXXXX``."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        above = code - 0x10000
        high = F.floor(above / 1024).cast("int") + 0xD800
        low = above % 1024 + 0xDC00
        return (
            F.when(ch == '"', F.lit('\\"'))
            .when(ch == "\\", F.lit("\\\\"))
            .when(ch == "\n", F.lit("\\n"))
            .when(ch == "\r", F.lit("\\r"))
            .when(ch == "\t", F.lit("\\t"))
            .when(ch == "\b", F.lit("\\b"))
            .when(ch == "\f", F.lit("\\f"))
            .when(code.between(32, 126), ch)
            .when(code > 0xFFFF, F.concat(unit(high), unit(low)))
            .otherwise(unit(code))
        )

    plain = F.concat(F.lit('"'), value, F.lit('"'))
    letters = F.filter(F.split(value, ""), lambda ch: ch != "")
    escaped = F.concat(F.lit('"'), F.array_join(F.transform(letters, escape), ""), F.lit('"'))
    encoded = F.when(value.rlike('[^ !#-\\[\\]-~]'), escaped).otherwise(plain)
    return F.coalesce(encoded, F.lit("null"))


def json_float(value: Column) -> Column:
    """Shortest decimal text with at least one decimal, as used for numbers of everyday size."""
    text = value.cast("string")
    trimmed = F.regexp_replace(text.cast("decimal(38,12)").cast("string"), "0+$", "")
    plain = F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    return F.when(text.contains("E"), plain).otherwise(text)


def json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ", "), F.lit("]"))


def json_object(members: dict[str, Column]) -> Column:
    """Object text with sorted keys and ``", "`` / ``": "`` between parts."""
    parts = []
    for position, key in enumerate(sorted(members)):
        lead = ", " if position else "{"
        parts += [F.lit(f'{lead}"{key}": '), members[key]]
    return F.concat(*parts, F.lit("}"))


def tx_id(members: dict[str, Column]) -> Column:
    return F.concat(F.lit("TX_"), F.left(sha256(json_object(members)), F.lit(24)))


def dna_json() -> Column:
    members = {}
    for name in DNA_HASH_FIELDS:
        column = F.col(name)
        if name in ARRAY_FIELDS:
            members[name] = json_list(column)
        elif name in ("created_at", "quality_sigma"):
            members[name] = json_float(column)
        else:
            members[name] = json_string(column)
    return json_object(members)


def dna_hash() -> Column:
    return sha256(dna_json())
