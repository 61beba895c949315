"""Models as user-supplied functions: span detectors and prompt-to-answer extractors.

A model is given as a loader, a function without arguments that returns the model. It is
called once per Python worker and kept, however many batches and partitions the worker
gets. Rows go through in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark import cloudpickle
from pyspark.sql import functions as F

from maskwright.functions.spans import SPAN, compute, empty, literal_spans, name, with_text
from maskwright.functions.text import fill_template

# Fixed value: the instruction of the extraction prompt.
EXTRACTION_PROMPT = (
    "Output all Personal Identifiable Information (PII) in the following text as a list of "
    "JSON objects with 'entity' and 'category' fields:\n'{original_text}'\n"
)
TEMPERATURE = 0.1
ENTITIES = "array<struct<entity:string,category:string>>"


def _kept_model(load: Callable[[], Any], label: str) -> Callable[[], Any]:
    """A function that loads the model at its first call in a Python worker.

    It is pickled by value and keeps the model on the ``builtins`` module, the one place
    that outlives the tasks of a worker without an import of this package, under its label and a
    digest of what loads it.
    """
    key = f"{label}:{hashlib.sha256(cloudpickle.dumps(load)).hexdigest()}"

    def get() -> Any:
        import builtins

        models = builtins.__dict__.setdefault("_maskwright_models", {})
        if key not in models:
            models[key] = load()
        return models[key]

    return get


def first_working(loaders: Sequence[Callable[[], Any]], probe: str = "warm up") -> Callable[[], Any]:
    """A loader that takes the first of several detectors which loads and answers a probe."""
    choices = list(loaders)

    def load() -> Any:
        reasons = []
        for choice in choices:
            try:
                model = choice()
                list(model([probe]))
                return model
            except Exception as exc:
                reasons.append(str(exc))
        raise RuntimeError("no model could be loaded: " + "; ".join(reasons))

    return load


def detect_with_model(
    docs: DataFrame,
    load: Callable[[], Callable[[list[str]], Iterable[Sequence[tuple]]]],
    label: str,
    text: str = "text",
    into: str = "model_spans",
) -> DataFrame:
    """Add the spans a model finds. The model maps a list of texts to, for each of them, tuples
    ``(start, end, entity_type, score)``; a score of None is 0. ``label`` names model and version.

    Give the column to ``detect(..., also=into)`` to resolve them together with the patterns.
    """
    model = _kept_model(load, label)
    element = "struct<start:int,end:int,entity_type:string,score:double>"

    def find_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = model()
        for texts in batches:
            known = [t for t in texts if t is not None]
            found = iter(find(known) if known else [])
            yield pd.Series(
                [
                    [
                        {"start": int(s), "end": int(e), "entity_type": kind, "score": float(score or 0.0)}
                        for s, e, kind, score in next(found)
                    ]
                    if t is not None
                    else []
                    for t in texts
                ]
            )

    # The hints must be types, not text, for Spark to see that the function takes batches.
    find_spans.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    spans = F.pandas_udf(find_spans, f"array<{element}>")
    found = docs.withColumn("_found", spans(F.col(text)))
    return compute(found, {into: f"array_sort({with_text(name(text), '_found')})"}).drop("_found")


def model_extract(
    docs: DataFrame,
    load: Callable[[], Callable[[list[str], list[int], float], Iterable[str]]],
    label: str,
    max_tokens: int | None = None,
    count_tokens: Callable[[str], int] | None = None,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    prompt: str = EXTRACTION_PROMPT,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Ask a model for the entities of each text: prompt in, ``answer`` out.

    The model maps prompts, their limits of new tokens and a temperature to answers. The
    limit is ``max_tokens`` or else the number of tokens of the text, by ``count_tokens``; with
    neither, it is None, so that no answer is cut short.
    """
    model = _kept_model(load, label)

    def run(batches):
        generate = model()
        count = count_tokens or (lambda t: None)
        for batch in batches:
            limits = [max_tokens or count(t or "") for t in batch["_source"]]
            answers = list(generate(batch["_prompt"].fillna("").tolist(), limits, temperature))
            yield batch[list(keep)].assign(answer=answers)

    asked = docs.select(*keep, F.col(text).alias("_source"), fill_template(prompt, F.col(text)).alias("_prompt"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return asked.mapInPandas(run, f"{schema}, answer string")


def parse_entities(answers: DataFrame, answer: str = "answer", into: str = "entities") -> DataFrame:
    """Read a model's answer as a list of ``{entity, category}``; NULL where it is none.

    Single quotes are allowed, as in the printed form of a Python list.
    """
    options = {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}
    read = F.from_json(F.col(answer), ENTITIES, options)
    whole = F.rlike(F.trim(F.col(answer)), F.lit(r"(?s)\A\[.*\]\z"))
    broken = F.exists(read, lambda e: e.isNull() | (e["entity"].isNull() & e["category"].isNull()))
    return answers.withColumn(into, F.when(whole & ~F.coalesce(broken, F.lit(True)), read))


def locate_entities(
    docs: DataFrame, text: str = "text", entities: str = "entities", score: float = 0.0, into: str = "model_spans"
) -> DataFrame:
    """Find every occurrence of each extracted entity in the text.

    The category becomes the entity type: capitals, with ``_`` for anything else. Where the
    entities are NULL, as after a broken answer, so are the spans.
    """
    kind = "upper(regexp_replace(entry.category, '[^A-Za-z]+', '_'))"
    spans = literal_spans(name(text), "entry.entity", kind, f"{float(score)}D")
    distinct = f"array_distinct(filter({name(entities)}, entry -> entry.entity IS NOT NULL AND entry.category IS NOT NULL))"
    located = f"array_sort(array_distinct(flatten(transform({distinct}, entry -> {spans}))))"
    return compute(docs, {into: located})

