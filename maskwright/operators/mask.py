"""Masking: documents with disjoint ``spans`` to documents with rewritten text."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import fernet
from maskwright.functions.fernet import KEY_COLUMNS, KeyRing
from maskwright.functions.fpe import preserve
from maskwright.functions.spans import ITEM, compute, empty, let, name, quoted, splice, spliced_items
from maskwright.operators.detect import MARKER_CLOSE, MARKER_OPEN
from maskwright.session import lookup_join

OPERATORS = ("encrypt", "anonymize", "preserve", "redact", "keep")
CARD = "s.entity_type = 'CREDIT_CARD'"
PIECE = "struct<start:int,end:int,entity_type:string,new:string>"


def with_keys(
    docs: DataFrame, keys: KeyRing, key_id: str | None = None, by: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Put the key parts on each row, by the column ``key_id`` or, if there is one key only, by its id.

    Rows whose key id is unknown get NULL key parts.
    """
    if key_id is None:
        if keys.only is None:
            raise ValueError("with more than one key, name the column that holds the key id")
        # Not a plain literal: with one, the join would lose its key and become a nested loop.
        docs = docs.withColumn("_key_id", F.when(F.col(text).isNotNull(), F.lit(keys.only)))
    else:
        docs = docs.withColumn("_key_id", F.col(key_id))
    table = keys.table.withColumnRenamed("key_id", "_key_id")
    return lookup_join(docs, table, "_key_id", small=keys.small, salt_by=by).drop("_key_id")


def with_salt(docs: DataFrame, salt: str, text: str = "text") -> DataFrame:
    """Put the salt on each row as data, like the keys, so that no plan or log shows it."""
    table = docs.sparkSession.createDataFrame([("salt", salt)], "_salt_id string, _salt string")
    # not a plain literal: with one, the join would lose its key
    named = docs.withColumn("_salt_id", F.when(F.col(text).isNotNull(), F.lit("salt")))
    return named.join(F.broadcast(table), "_salt_id", "left").drop("_salt_id")


def _anonymized(modulus: int) -> str:
    digest = "substr(sha2(concat(_salt, s.text), 256), 1, 15)"
    number = f"pmod(CAST(conv({digest}, 16, 10) AS bigint), {int(modulus)})"
    return f"concat('[', s.entity_type, '_', {number}, ']')"


def _encrypted(by: str, epoch_seconds: int) -> str:
    context = f"concat_ws(':', CAST({name(by)} AS string), s.start, s.text)"
    token = fernet.encrypt("s.text", str(int(epoch_seconds)), fernet.derived_iv(context))
    return f"concat({quoted(MARKER_OPEN)}, s.entity_type, ':', {token}, {quoted(MARKER_CLOSE)})"


def mask(
    docs: DataFrame,
    mode: str = "anonymize",
    keys: KeyRing | None = None,
    key_id: str | None = None,
    policy: Mapping[str, str] | None = None,
    salt: str | None = None,
    modulus: int = 10_000,
    now: datetime | None = None,
    text: str = "text",
    spans: str = "spans",
    by: str = "doc_id",
    into: str = "masked",
) -> DataFrame:
    """Replace every span and add ``<into>`` (the text) and ``items`` (spans in the new text).

    ``mode`` is the operator for all types; ``policy`` names another one for single types:

    - ``encrypt``: ``{{ENC:TYPE:token}}``, to be restored with the key;
    - ``anonymize``: ``[TYPE_n]``, n from a salted hash of the text, equal for equal texts;
    - ``preserve``: its digits are encrypted to other digits and all else stays, to be restored with the key by
      ``unmask.restore_preserved``; a card number still passes its test. A text with fewer than 6 digits, or more
      than 36, is redacted;
    - ``redact``: ``<TYPE>``;
    - ``keep``: the text stays and is not listed in ``items``.

    ``encrypt`` needs ``keys`` (see ``functions.fernet.key_ring``) and ``now``, one time for
    the whole run, so that retried tasks write the same tokens. ``anonymize`` needs ``salt``. ``by`` identifies a document;
    where its key is unknown, the new text is NULL. The same holds where ``spans`` is NULL,
    that is, where nobody knows what to mask; see ``masking_error``.
    """
    policy = dict(policy or {})
    wrong = ({mode} | set(policy.values())) - set(OPERATORS)
    if wrong:
        raise ValueError(f"unknown operator {', '.join(sorted(wrong))}; use {', '.join(OPERATORS)}")
    used = {mode} | set(policy.values())
    if "encrypt" in used and now is None:
        raise ValueError("encrypt needs keys and now")
    keyed = bool(used & {"encrypt", "preserve"})
    if keyed:
        if keys is None:
            raise ValueError("encrypt needs keys and now" if "encrypt" in used else "preserve needs keys")
        docs = with_keys(docs, keys, key_id, by, text)
    if "anonymize" in used:
        if not salt:
            raise ValueError("anonymize needs a salt, as the numbers of common texts could be guessed")
        docs = with_salt(docs, salt, text)
    replacement = {
        "encrypt": _encrypted(by, int(now.timestamp())) if now is not None else "",
        "anonymize": _anonymized(modulus),
        "redact": "concat('<', s.entity_type, '>')",
        "preserve": f"coalesce({preserve('s.text', CARD)}, concat('<', s.entity_type, '>'))" if "preserve" in used else "",
        "keep": "s.text",
    }
    new = replacement[mode]
    if policy:
        arms = " ".join(f"WHEN {quoted(kind)} THEN {replacement[op]}" for kind, op in sorted(policy.items()))
        new = f"CASE s.entity_type {arms} ELSE {new} END"
    kept = [quoted(kind) for kind, op in policy.items() if op == "keep"]
    changed = [quoted(kind) for kind, op in policy.items() if op != "keep"]
    source = name(spans)
    if mode == "keep":
        source = f"filter({source}, s -> s.entity_type IN ({', '.join(changed) or 'NULL'}))"
    elif kept:
        source = f"filter({source}, s -> s.entity_type NOT IN ({', '.join(kept)}))"
    pieces = f"transform({source}, s -> CAST(struct(s.start, s.end, s.entity_type, {new}) AS {PIECE}))"
    rewritten = (
        f"named_struct({quoted(into)}, {splice(name(text), 'pieces')}, 'items', {spliced_items('pieces')})"
    )
    untouched = f"named_struct({quoted(into)}, {name(text)}, 'items', {empty(ITEM)})"
    result = f"if(size({name(spans)}) > 0, {let('pieces', pieces, rewritten)}, {untouched})"
    if keyed:
        # Without a key a document comes out as NULL: neither in the clear nor incomplete.
        lost = f"named_struct({quoted(into)}, CAST(NULL AS string), 'items', {empty(ITEM)})"
        result = f"if(size({name(spans)}) > 0 AND enc_key IS NULL, {lost}, {result})"
    unknown = f"named_struct({quoted(into)}, CAST(NULL AS string), 'items', {empty(ITEM)})"
    result = f"if({name(spans)} IS NULL, {unknown}, {result})"
    masked = compute(docs, result, names=(into, "items")).drop("_salt")
    return masked.drop(*KEY_COLUMNS) if keyed else masked


def masking_error(text: str = "text", spans: str = "spans", masked: str = "masked") -> Column:
    """Why a document has no masked text: ``no findings`` or ``unknown key``; NULL where it has one."""
    lost = F.col(text).isNotNull() & F.col(masked).isNull()
    return F.when(lost, F.when(F.col(spans).isNull(), "no findings").otherwise("unknown key"))


def mask_numbered(
    docs: DataFrame, text: str = "text", spans: str = "spans", into: str = "masked", brackets: bool = False
) -> DataFrame:
    """Replace spans by ``TYPE_n``, n counting the occurrences of the type in the document."""
    kinds = f"array_distinct(transform({name(spans)}, s -> s.entity_type))"
    label = "concat(kind, '_', i + 1)"
    if brackets:
        label = f"concat('[', {label}, ']')"
    # Per type, the occurrences get their numbers by position; then all are put in order.
    numbered = (
        f"array_sort(flatten(transform({kinds}, kind -> transform("
        f"filter({name(spans)}, s -> s.entity_type = kind),"
        f" (s, i) -> CAST(struct(s.start, s.end, kind, {label}) AS {PIECE})))))"
    )
    rewritten = let("pieces", numbered, splice(name(text), "pieces"))
    return compute(docs, {into: f"CASE WHEN size({name(spans)}) > 0 THEN {rewritten} WHEN {name(spans)} IS NOT NULL THEN {name(text)} END"})


def placeholder_counts(docs: DataFrame, text: str = "masked") -> DataFrame:
    """How often each bracketed placeholder occurs; the name in capitals, without brackets."""
    found = f"regexp_extract_all({name(text)}, {quoted(PLACEHOLDER_PATTERN)}, 0)"
    labels = f"transform({found}, p -> upper(regexp_replace(p, {quoted(BRACKET_ENDS)}, '')))"
    return (
        docs.select(F.expr(f"explode(if(contains({name(text)}, '['), {labels}, array()))").alias("placeholder"))
        .groupBy("placeholder")
        .agg(F.count("*").alias("n"))
    )


# What a bracketed placeholder looks like; its brackets are stripped off.
PLACEHOLDER_PATTERN = r"\[.*?\]"
BRACKET_ENDS = r"^[\[\]]+|[\[\]]+$"
