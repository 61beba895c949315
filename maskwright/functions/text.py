"""Text and path column functions: normalisation, routing, naming, prompts, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as blank when a line or a text is stripped.
BLANK_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
BLANKS = "".join(chr(c) for first, last in BLANK_RANGES for c in range(first, last + 1))


def unify_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    crlf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\r")), F.replace(crlf, F.lit("\r"), F.lit("\n"))).otherwise(text)


def strip_line_ends(text: Column) -> Column:
    """Remove blanks at the end of every line; line by line, which is faster than a pattern."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.rtrim(line, F.lit(BLANKS)))
    return F.array_join(lines, "\n")


def squeeze_blank_lines(text: Column) -> Column:
    """Three or more newlines in a row become two."""
    return F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)


def strip_ends(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalize_text(text: Column) -> Column:
    """Newlines unified, line ends and blank lines trimmed, exactly one final newline."""
    return F.concat(strip_ends(squeeze_blank_lines(strip_line_ends(unify_newlines(text)))), F.lit("\n"))


def first_nonempty(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor empty; NULL if there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def fill_template(template: str, text: Column, slot: str = "{original_text}") -> Column:
    return F.replace(F.lit(template), F.lit(slot), text)


# --- paths ---------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    head = F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)))
    return F.when(F.rlike(head, F.lit(r"\A/+\z")), head).otherwise(F.regexp_replace(head, r"/+\z", ""))


def extension(path: Column) -> Column:
    """Extension with its dot; a name that only starts with dots has none."""
    return F.regexp_extract(basename(path), r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    base = basename(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(path)))


def join_path(directory: Column, name: Column) -> Column:
    return (
        F.when(directory == "", name)
        .when(F.endswith(directory, F.lit("/")), F.concat(directory, name))
        .otherwise(F.concat_ws("/", directory, name))
    )


def is_pdf(path: Column) -> Column:
    return F.lower(extension(path)) == ".pdf"


def output_dir(path: Column) -> Column:
    """Default output folder: one named after the input, next to it."""
    return join_path(dirname(path), stem(path))


def output_path(path: Column) -> Column:
    return join_path(output_dir(path), F.concat(stem(path), F.lit(".md")))


def report_path(out_path: Column) -> Column:
    return F.concat(out_path, F.lit(".pii.json"))


def decrypted_path(path: Column, outdir: str | None = None) -> Column:
    name = F.concat(stem(path), F.lit(".decrypted.md"))
    if outdir is not None:
        return join_path(F.lit(outdir), name)
    folder = dirname(path)
    return join_path(F.when(folder == "", F.lit(".")).otherwise(folder), name)


# --- key=value metadata --------------------------------------------------------------


def parse_key_values(items: Column) -> Column:
    """``key=value`` strings to a map, cut at the first ``=``; the last of equal keys wins.

    Items without ``=`` are left out; count them with :func:`invalid_key_values`.
    """
    valid = F.filter(items, lambda item: F.contains(item, F.lit("=")))
    pairs = F.transform(
        valid,
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("key"),
            F.substring(item, F.instr(item, "=") + 1, F.length(item)).alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(
        keys,
        lambda key: F.struct(
            key.alias("key"),
            F.element_at(F.filter(pairs, lambda p: p["key"] == key), -1)["value"].alias("value"),
        ),
    )
    return F.map_from_entries(last)


def invalid_key_values(items: Column) -> Column:
    return F.size(F.filter(items, lambda item: ~F.contains(item, F.lit("="))))
