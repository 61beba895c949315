"""Restoring: masked documents back to their text, for holders of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from maskwright.functions import fernet
from maskwright.functions.fernet import KEY_COLUMNS, KeyRing
from maskwright.functions.fpe import preserve
from maskwright.functions.spans import Cut, compute, let, name, quoted, record, splice, with_slicer
from maskwright.operators.detect import MARKER_OPEN, MARKER_PATTERN
from maskwright.operators.mask import CARD, with_keys


def unmask(
    docs: DataFrame,
    keys: KeyRing,
    key_id: str | None = None,
    text: str = "masked",
    by: str = "doc_id",
    into: str = "text",
) -> DataFrame:
    """Replace every marker by its plain text and add ``markers_found`` and ``markers_decrypted``.

    A marker that does not decrypt (other key, forged, damaged) stays as it is.
    """
    source = name(text)
    pattern = quoted(MARKER_PATTERN)
    token = f"regexp_extract(m, {pattern}, 2)"
    plain = fernet.decrypt(token)
    restored = (
        f"transform(regexp_extract_all({source}, {pattern}, 0),"
        f" m -> named_struct('marker', m, 'plain', {plain}))"
    )
    # One more gap than markers: the last gap is joined to nothing.
    body = (
        f"array_join(zip_with(split({source}, {pattern}, -1), found,"
        " (g, m) -> concat(coalesce(g, ''), coalesce(m.plain, m.marker, ''))), '')"
    )
    opened = "size(filter(found, m -> m.plain IS NOT NULL))"
    fields = f"named_struct({quoted(into)}, %s, 'markers_found', %s, 'markers_decrypted', %s)"
    result = (
        f"if(contains({source}, {quoted(MARKER_OPEN)}),"
        f" {let('found', restored, fields % (body, 'size(found)', opened))}, {fields % (source, '0', '0')})"
    )
    names = (into, "markers_found", "markers_decrypted")
    return compute(with_keys(docs, keys, key_id, by, text), result, names=names).drop(*KEY_COLUMNS)


def unmask_items(
    docs: DataFrame,
    keys: KeyRing,
    key_id: str | None = None,
    text: str = "masked",
    items: str = "items",
    by: str = "doc_id",
    into: str = "text",
) -> DataFrame:
    """Replace the slices that ``items`` names, wherever they hold a marker that decrypts."""
    source, spans = name(text), name(items)
    inner = f"regexp_extract(m, {quoted('^' + MARKER_PATTERN + '$')}, 2)"

    def restored(cut: Cut) -> str:
        new = let("m", cut("s.start", "s.end - s.start"), f"coalesce({fernet.decrypt(inner)}, m)")
        return f"transform({spans}, s -> {record(start='s.start', end='s.end', new=new)})"

    pieces = with_slicer(source, f"size({spans})", restored)
    return compute(
        with_keys(docs, keys, key_id, by, text), {into: let("pieces", pieces, splice(source, "pieces"))}
    ).drop(*KEY_COLUMNS)


def count_markers(docs: DataFrame, text: str = "masked", into: str = "markers_found") -> DataFrame:
    found = f"regexp_count({name(text)}, {quoted(MARKER_PATTERN)})"
    return compute(docs, {into: f"if(contains({name(text)}, {quoted(MARKER_OPEN)}), {found}, 0)"})


def restore_preserved(
    docs: DataFrame, keys: KeyRing, key_id: str | None = None, text: str = "masked", items: str = "items", by: str = "doc_id", into: str = "text"
) -> DataFrame:
    """Turn the digits that ``preserve`` encrypted back, at the places that ``items`` names.

    Without the key the result is NULL. Items that were redacted stay as they are.
    """

    def pieces(cut: Cut) -> str:
        slices = f"transform({name(items)}, e -> named_struct('start', e.start, 'end', e.end, 'entity_type', e.entity_type, 'text', {cut('e.start', 'e.end - e.start')}))"
        new = f"if(s.text = concat('<', s.entity_type, '>'), s.text, {preserve('s.text', CARD, back=True)})"
        turned = f"transform({slices}, s -> named_struct('start', s.start, 'end', s.end, 'new', coalesce({new}, s.text)))"
        return let("pieces", turned, splice(name(text), "pieces"))

    whole = f"if(size({name(items)}) > 0, {with_slicer(name(text), f'size({name(items)})', pieces)}, {name(text)})"
    result = f"if(size({name(items)}) > 0 AND enc_key IS NULL, NULL, {whole})"
    return compute(with_keys(docs, keys, key_id, by, text), {into: result}).drop(*KEY_COLUMNS)
