"""Keys that change over time: a token tells when it was made, and the key is the one that was valid then."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import fernet
from maskwright.functions.fernet import KEY_COLUMNS, KeyRing, ensure_key
from maskwright.functions.spans import compute, let, name, quoted
from maskwright.operators.detect import MARKER_CLOSE, MARKER_OPEN, MARKER_PATTERN
from maskwright.operators.mask import with_keys
from maskwright.session import fits_broadcast, lookup_join

VERSION = "struct<valid_from:bigint,enc_key:binary,ipad:binary,opad:binary>"


@dataclass(frozen=True)
class VersionRing:
    """A table of owners and their key versions, oldest first; whether it may be broadcast."""

    table: DataFrame
    small: bool


def version_ring(spark: SparkSession, versions: Iterable[tuple[str, datetime, str]]) -> VersionRing:
    """Keys by owner and the time from which they are valid. They travel as data, like all keys."""
    rows = []
    for owner, valid_from, key in versions:
        raw = base64.urlsafe_b64decode(ensure_key(key))
        signing = raw[:16].ljust(64, b"\0")
        rows.append((owner, int(valid_from.timestamp()), bytearray(raw[16:]), bytearray(b ^ 0x36 for b in signing), bytearray(b ^ 0x5C for b in signing)))
    table = spark.createDataFrame(rows, "owner string, valid_from bigint, enc_key binary, ipad binary, opad binary")
    listed = table.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("valid_from", "enc_key", "ipad", "opad"))).alias("_versions"))
    return VersionRing(listed, fits_broadcast(table))


def _made(token: str) -> str:
    """SQL for the time of a token, in seconds; NULL if it is none."""
    return f"CAST(conv(hex(substring(try_to_binary(translate({token}, '-_', '+/'), 'base64'), 2, 8)), 16, 10) AS bigint)"


def _valid(token: str) -> str:
    """SQL for the newest version that is not younger than a token; NULL if all are."""
    return f"try_element_at(filter(_versions, e -> e.valid_from <= {_made(token)}), -1)"


def _with_versions(docs: DataFrame, ring: VersionRing, owner: str, by: str) -> DataFrame:
    keyed = docs.withColumn("_owner", F.col(owner).cast("string"))
    table = ring.table.withColumnRenamed("owner", "_owner")
    return lookup_join(keyed, table, "_owner", small=ring.small, salt_by=by).drop("_owner")


def token_versions(docs: DataFrame, ring: VersionRing, owner: str, text: str = "masked", by: str = "doc_id") -> DataFrame:
    """``by``, n, made, valid_from of every marker: when it was made and since when its key was valid, NULL if there was none."""
    token = f"regexp_extract(m, {quoted(MARKER_PATTERN)}, 2)"
    rows = f"transform(regexp_extract_all({name(text)}, {quoted(MARKER_PATTERN)}, 0), m -> named_struct('made', {_made(token)}, 'valid_from', {_valid(token)}.valid_from))"
    found = _with_versions(docs.select(by, owner, text), ring, owner, by).selectExpr(name(by), f"posexplode({rows}) AS (n, t)")
    return found.select(by, "n", "t.made", "t.valid_from")


def _turned(source: str, new: str) -> str:
    """SQL for found markers: each with what becomes of it, from its plain text ``p.plain`` and number ``p.n``."""
    pattern = quoted(MARKER_PATTERN)
    token = f"regexp_extract(m, {pattern}, 2)"
    plain = fernet.decrypt(token, "v.enc_key", "v.ipad", "v.opad")
    opened = let("v", _valid(token), f"named_struct('marker', m, 'n', i, 'plain', {plain})")
    return f"transform(transform(regexp_extract_all({source}, {pattern}, 0), (m, i) -> {opened}), p -> named_struct('new', coalesce({new}, p.marker), 'ok', p.plain IS NOT NULL))"


def _replaced(docs: DataFrame, text: str, new: str, into: str) -> DataFrame:
    source, pattern = name(text), quoted(MARKER_PATTERN)
    body = f"array_join(zip_with(split({source}, {pattern}, -1), found, (g, m) -> concat(coalesce(g, ''), coalesce(m.new, ''))), '')"
    fields = f"named_struct({quoted(into)}, %s, 'markers_found', %s, 'markers_decrypted', %s)"
    some = let("found", _turned(source, new), fields % (body, "size(found)", "size(filter(found, m -> m.ok))"))
    result = f"if(contains({source}, {quoted(MARKER_OPEN)}), {some}, {fields % (source, '0', '0')})"
    return compute(docs, result, names=(into, "markers_found", "markers_decrypted"))


def unmask_versions(docs: DataFrame, ring: VersionRing, owner: str, text: str = "masked", by: str = "doc_id", into: str = "text") -> DataFrame:
    """Replace every marker by its plain text, under the version that was valid when it was made."""
    return _replaced(_with_versions(docs, ring, owner, by), text, "p.plain", into).drop("_versions")


def rotate(docs: DataFrame, ring: VersionRing, owner: str, keys: KeyRing, now: datetime, text: str = "masked", by: str = "doc_id", key_id: str | None = None) -> DataFrame:
    """Encrypt every marker anew under ``keys``, at ``now``; what does not decrypt stays as it is.

    The plain text is in no column. A marker keeps its type; retried tasks write the same tokens.
    """
    kind = f"regexp_extract(p.marker, {quoted(MARKER_PATTERN)}, 1)"
    iv = fernet.derived_iv(f"concat_ws(':', CAST({name(by)} AS string), p.n, p.plain)")
    token = fernet.encrypt("p.plain", str(int(now.timestamp())), iv)
    marker = f"if(p.plain IS NULL OR enc_key IS NULL, NULL, concat({quoted(MARKER_OPEN)}, {kind}, ':', {token}, {quoted(MARKER_CLOSE)}))"
    ready = with_keys(_with_versions(docs, ring, owner, by), keys, key_id, by, text)
    return _replaced(ready, text, marker, text).drop("_versions", *KEY_COLUMNS)
