"""Names of objects: addresses, content hashes, deterministic ids and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace that name-based ids are made in.
NAMESPACE = "6f067160c9794ef580df570f684d20b8"
_ADDRESS = r"^[a-z0-9]+://([^/]+)/(.+)$"


def scheme(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"^([a-z0-9]+)://", 1))


def bucket(uri: Column) -> Column:
    """The part before the first / of an address scheme://bucket/key; empty for anything else."""
    return F.regexp_extract(uri, _ADDRESS, 1)


def key(uri: Column) -> Column:
    return F.regexp_extract(uri, _ADDRESS, 2)


def checked(uri: Column, kind: str = "s3") -> Column:
    """The address, or an error if it is none of this kind."""
    return F.when(uri.rlike(rf"^{kind}://[^/]+/.+$"), uri).otherwise(F.raise_error(F.concat(F.lit("no such address: "), F.coalesce(uri, F.lit("null")))))


def ending(name: Column, default: str = ".bin") -> Column:
    """A file name's ending in lower case."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.regexp_extract(name, r"[^/?#]*$", 0), r"(\.[A-Za-z0-9]+)$", 1)), F.lit("")), F.lit(default))


def object_name(tenant: Column, sha: Column, filename: Column) -> Column:
    return F.concat(tenant, F.lit("/sha256/"), sha, ending(filename))


def safe_filename(name: Column) -> Column:
    """Other signs than letters, digits, _ and - as _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_"), r"^_+|_+$", "")


def display_name(ident: Column) -> Column:
    return F.initcap(F.translate(ident, "_-", "  "))


def deterministic_uuid(*parts: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based (SHA-1) UUID of the parts joined by ::."""
    text = F.concat_ws("::", *(p.cast("string") for p in parts))
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    at = lambda start, n: F.substring(digest, start, n)
    variant = F.lower(F.hex(F.conv(at(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))
