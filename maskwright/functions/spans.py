"""Span arithmetic inside one row, as SQL expressions.

A span is ``STRUCT<start, end, entity_type, score, text>`` with 0-based, end-exclusive
code-point offsets. Everything here works on the row alone, so detection and masking need
no shuffle, and the cost stays linear in the text and near-linear in the number of spans.
Two things take care of that: ``aggregate`` copies its accumulator in every step, so only
short arrays of numbers are grown in it, block by block; and long texts are cut into
chunks, so that taking a slice does not walk the text from its beginning.

The functions take and give SQL text, which ``F.expr`` turns into a column in one call;
the same trees built through ``pyspark.sql.functions`` cost seconds of driver time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

SPAN = "struct<start:int,end:int,entity_type:string,score:double,text:string>"
PLACED = "struct<start:int,end:int,entity_type:string,score:double,text:string,line:int,column:int>"
ITEM = "struct<start:int,end:int,entity_type:string>"
BLOCK = 32
CHUNK = 4096


def quoted(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "CAST(NULL AS string)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


LAMBDA_NAMES = frozenset(
    "a acc b bases before begins block blocks body c ch chain chunks clash digits e entry f facts fixed found g gaps h i j k"
    " kept kind lines m mac made n now opened ordered p part pieces r raw reach rest reversed s shift signed turned v vals w x".split()
)


def name(column: str) -> str:
    """A quoted column name; dots are part of the name."""
    if column.lower() in LAMBDA_NAMES:
        raise ValueError(f"rename the column {column!r}: the expressions use this name themselves")
    return "`" + column.replace("`", "``") + "`"


def compute(df: DataFrame, columns: dict[str, str] | str, names: Iterable[str] = ()) -> DataFrame:
    """Add columns that are costly to compute, so that they are computed once per row.

    A plain projection would be copied into every filter that a caller puts on the new
    columns, and further down with each step. A generator over a single struct is not, and
    still lets filters on the other columns through to the scan. ``columns`` maps names to
    SQL, or is SQL for a struct with the fields ``names``.
    """
    if isinstance(columns, str):
        made, struct = set(names), columns
    else:
        made = set(columns)
        struct = "named_struct(" + ", ".join(f"{quoted(c)}, {sql}" for c, sql in columns.items()) + ")"
    kept = [name_any(c) for c in df.columns if c not in made]
    return df.selectExpr(*kept, f"inline(array({struct}))")


def name_any(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def let(variable: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use ``variable`` in ``body`` any number of times."""
    return f"get(transform(array({value}), {variable} -> {body}), 0)"


def record(**fields: str) -> str:
    """A struct by field names."""
    return "named_struct(" + ", ".join(f"'{field}', {value}" for field, value in fields.items()) + ")"


def empty(element: str) -> str:
    return f"CAST(array() AS array<{element}>)"


# --- running values ------------------------------------------------------------------


def running(values: str, combine: Callable[[str, str], str], levels: int = 3) -> str:
    """For each number the combination of those before it, from 0: running sums or maxima.

    More than one block of numbers are first combined block by block, and the blocks' totals
    are run over in the same way, so that no accumulator gets long.
    """

    def within(numbers: str, start: str) -> str:
        step = record(now=combine("acc.now", "x"), out="concat(acc.out, array(acc.now))")
        return f"aggregate({numbers}, {record(now=start, out=empty('int'))}, (acc, x) -> {step}, acc -> acc.out)"

    if levels == 0:
        return within(values, "0")
    cut = f"transform(sequence(0, CAST((size(vals) - 1) div {BLOCK} AS int)), b -> slice(vals, b * {BLOCK} + 1, {BLOCK}))"
    totals = f"transform(blocks, block -> aggregate(block, 0, (acc, x) -> {combine('acc', 'x')}))"
    filled = f"flatten(transform(blocks, (block, b) -> {within('block', 'get(bases, b)')}))"
    by_block = let("blocks", cut, let("bases", running(totals, combine, levels - 1), filled))
    return let("vals", values, f"if(size(vals) <= {BLOCK}, {within('vals', '0')}, {by_block})")


def running_sum(values: str) -> str:
    return running(values, lambda a, b: f"{a} + {b}")


def running_max(values: str) -> str:
    return running(values, lambda a, b: f"greatest({a}, {b})")


# --- slices --------------------------------------------------------------------------

Cut = Callable[[str, str], str]


def with_slicer(text: str, wanted: str, body: Callable[[Cut], str]) -> str:
    """Give ``body`` a function ``cut(start, length)`` of ``text``.

    ``wanted`` is the number of slices. Few slices or a short text use ``substring``; else
    the text is cut once into chunks and a slice touches only the chunks it lies in.
    """
    whole = body(lambda start, length: f"substring({text}, {start} + 1, {length})")

    def from_chunks(start: str, length: str) -> str:
        first = f"CAST(floor(({start}) / {CHUNK}) AS int)"
        count = f"CAST(floor((({start}) % {CHUNK} + ({length})) / {CHUNK}) AS int) + 1"
        return f"substring(array_join(slice(chunks, {first} + 1, {count}), ''), ({start}) % {CHUNK} + 1, {length})"

    pieces = f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"
    return (
        f"if({wanted} > 16 AND length({text}) > {4 * CHUNK},"
        f" {let('chunks', pieces, body(from_chunks))}, {whole})"
    )


# --- matches to spans ----------------------------------------------------------------


def located(found: str, gaps: str, entity_type: str, score: Callable[[str], str]) -> str:
    """Turn the matches ``found`` into spans, given the ``gaps`` before, between and after them.

    ``score`` gives SQL for a score from SQL for the gap, the text since the match before.
    """
    lengths = f"zip_with({found}, slice({gaps}, 1, size({found})), (m, g) -> length(g) + length(m))"
    gap = f"get({gaps}, i)"
    begin = f"get(before, i) + length({gap})"
    span = record(
        start=begin,
        end=f"{begin} + length(m)",
        entity_type=entity_type,
        score=f"coalesce({score(gap)}, 0D)",
        text="m",
    )
    return let("before", running_sum(lengths), f"transform({found}, (m, i) -> {span})")


def literal_spans(text: str, needle: str, entity_type: str, score: str) -> str:
    """All non-overlapping occurrences of a literal string, left to right."""
    pattern = f"regexp_replace({needle}, {quoted(LITERAL_SPECIALS)}, {quoted(LITERAL_ESCAPE)})"
    spans = let(
        "found", f"array_repeat({needle}, size(gaps) - 1)", located("found", "gaps", entity_type, lambda gap: score)
    )
    return (
        f"if(length({needle}) > 0 AND contains({text}, {needle}),"
        f" {let('gaps', f'split({text}, {pattern}, -1)', spans)}, {empty(SPAN)})"
    )


LITERAL_SPECIALS = r"([\\.\[\](){}*+?^$|])"
LITERAL_ESCAPE = r"\\$1"


def with_text(text: str, spans: str) -> str:
    """Spans with the text that stands at their place; NULL spans are none."""

    def read(cut: Cut) -> str:
        span = record(
            start="s.start", end="s.end", entity_type="s.entity_type", score="s.score",
            text=cut("s.start", "s.end - s.start"),
        )
        return f"transform({spans}, s -> {span})"

    return f"if(size({spans}) > 0, {with_slicer(text, f'size({spans})', read)}, {empty(SPAN)})"


# --- overlaps ------------------------------------------------------------------------


def _by_cluster(spans: str, finish: Callable[[str], str]) -> str:
    """Cut start-ordered spans into chains of overlapping ones and apply ``finish`` to each."""
    begins = f"filter(sequence(0, size({spans}) - 1), i -> get({spans}, i).start >= get(reach, i))"
    next_begin = f"coalesce(get(begins, i + 1), size({spans}))"
    chains = f"transform(begins, (b, i) -> slice({spans}, b + 1, {next_begin} - b))"
    done = f"flatten(transform({chains}, chain -> if(size(chain) < 2, chain, {finish('chain')})))"
    return let("reach", running_max(f"transform({spans}, s -> s.end)"), let("begins", begins, done))


def _unless_disjoint(spans: str, finish: Callable[[str], str]) -> str:
    clash = (
        f"exists(zip_with(slice({spans}, 1, size({spans}) - 1), slice({spans}, 2, size({spans}) - 1),"
        " (a, b) -> b.start < a.end), clash -> clash)"
    )
    return f"if(size({spans}) > 1 AND {clash}, {_by_cluster(spans, finish)}, {spans})"


def resolve_overlaps(spans: str) -> str:
    """Keep a disjoint set out of start-ordered spans, longest first.

    Ties go to the higher score, the earlier start, then the entity type. A span with an
    empty entity type is an area that must stay as it is: it wins over everything.
    """

    def greedy(chain: str) -> str:
        rank = record(
            open="c.entity_type <> ''", longest="c.start - c.end", best="-c.score", start="c.start",
            kind="c.entity_type", end="c.end", at="i",
        )
        ranked = f"transform(array_sort(transform({chain}, (c, i) -> {rank})), r -> {record(start='r.start', end='r.end', at='r.at')})"
        kept = (
            f"aggregate({ranked}, {empty('struct<start:int,end:int,at:int>')}, (kept, r) ->"
            " if(exists(kept, k -> k.start < r.end AND r.start < k.end), kept, concat(kept, array(r))))"
        )
        return f"transform(array_sort({kept}), k -> get({chain}, k.at))"

    return _unless_disjoint(spans, greedy)


def drop_in_protected(spans: str) -> str:
    """Leave out spans which overlap a protected area, keeping other overlaps."""

    def outside(chain: str) -> str:
        return let(
            "fixed",
            f"filter({chain}, c -> c.entity_type = '')",
            f"filter({chain}, c -> c.entity_type = '' OR"
            " NOT exists(fixed, p -> p.start < c.end AND c.start < p.end))",
        )

    return _unless_disjoint(spans, outside)


# --- line and column -----------------------------------------------------------------


def with_line_column(text: str, spans: str) -> str:
    """Add the 1-based line and column of each start to start-ordered spans."""

    def walk(cut: Cut) -> str:
        # Per span, the text since the span before: its newlines, and where its last line begins.
        previous = f"coalesce(get({spans}, i - 1).start, 0)"
        part = cut(previous, f"s.start - {previous}")
        facts = let(
            "part",
            part,
            record(
                breaks="length(part) - length(replace(part, '\\n', ''))",
                opens="if(contains(part, '\\n'), s.start - length(substring_index(part, '\\n', -1)), 0)",
            ),
        )
        row = record(
            start="s.start", end="s.end", entity_type="s.entity_type", score="s.score", text="s.text",
            line="get(lines, i) + get(facts, i).breaks + 1",
            column="s.start - greatest(get(opened, i), get(facts, i).opens) + 1",
        )
        lines = running_sum("transform(facts, f -> f.breaks)")
        opened = running_max("transform(facts, f -> f.opens)")
        rows = let("lines", lines, let("opened", opened, f"transform({spans}, (s, i) -> {row})"))
        return let("facts", f"transform({spans}, (s, i) -> {facts})", rows)

    return f"if(size({spans}) > 0, {with_slicer(text, f'size({spans})', walk)}, {empty(PLACED)})"


# --- rewriting -----------------------------------------------------------------------


def splice(text: str, pieces: str) -> str:
    """Replace disjoint start-ordered ``pieces`` (with ``start``, ``end``, ``new``) in one pass."""

    def rebuild(cut: Cut) -> str:
        before = f"coalesce(get({pieces}, i - 1).end, 0)"
        body = f"transform({pieces}, (p, i) -> concat({cut(before, f'p.start - {before}')}, p.new))"
        last = f"element_at({pieces}, -1).end"
        return f"concat(array_join({body}, ''), {cut(last, f'length({text}) - {last}')})"

    return f"if(size({pieces}) > 0, {with_slicer(text, f'size({pieces})', rebuild)}, {text})"


def spliced_items(pieces: str) -> str:
    """Where the replacements of :func:`splice` stand in the new text."""
    begin = "p.start + get(shift, i)"
    item = record(start=begin, end=f"{begin} + length(p.new)", entity_type="p.entity_type")
    shift = running_sum(f"transform({pieces}, p -> length(p.new) - (p.end - p.start))")
    return let("shift", shift, f"transform({pieces}, (p, i) -> {item})")
