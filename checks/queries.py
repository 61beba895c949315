"""One query per operator, over the whole given tables.

Where an operator's natural input (files, PDFs, model answers) is not among the tables, it
is derived from them, here and in ``checks.oracles`` alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.fernet import key_ring
from maskwright.functions.recognizers import RECOGNIZERS, Recognizer
from maskwright.functions import text as tx
from maskwright.operators import audit, audit_log, retention
from maskwright.operators.detect import MARKER_PATTERN, detect, filter_by_list, filter_entities, matches
from maskwright.operators.dictionary import dictionary_spans, with_dictionary
from maskwright.operators.evaluate import scores
from maskwright.operators.extract import assemble_pages, extract_text
from maskwright.operators.mask import mask, mask_numbered, masking_error, placeholder_counts
from maskwright.operators.models import detect_with_model, locate_entities, model_extract, parse_entities
from maskwright.operators.numbering import mask_with_numbers, number_texts
from maskwright.operators.report import (
    entity_counts,
    entity_rollup,
    report,
    report_json,
    top_docs,
    with_counts,
)
from maskwright.operators.tagger import tag, train_tagger
from maskwright.operators.training import chat_messages, entities_of, masking_prompt, with_split
from maskwright.operators.rotation import rotate, token_versions, version_ring
from maskwright.operators.unmask import restore_preserved, unmask, unmask_items
from maskwright.operators.upload import upload_manifest
from maskwright.plans.protect import protect
from maskwright.session import fits_broadcast, lookup_join, scratch_path, spread, written
from maskwright.sources import versioned
from maskwright.sources.documents import decode_documents, file_inventory, load_split, read_documents, route
from maskwright.streaming.protect_stream import protect_stream, table_stream
from maskwright.streaming.window_counts import count_stream, read_counts

SALT = "pepper"
USER = "tester"
NOW = datetime(2025, 1, 1, 12, 0, tzinfo=timezone.utc)
# Keys for these checks only; a real key comes from a key store.
KEY = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="
OTHER_KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="
DOMAIN = Recognizer(
    "DOMAIN_NAME",
    "(?<![0-9A-Za-z_])[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,6}(?![0-9A-Za-z_])",
    0.3,
)
SPAN_COLUMNS = ("start", "end", "entity_type", "score", "text")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    wanted = columns or ("doc_id", "text")
    return spread(table(spark, sf, "documents").select(*wanted), "doc_id")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.concat_ws("\n", "url", "html").alias("text"))
    return spread(rows, "page_id")


def span_rows(docs: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    # An expression, so that no filter on the spans is inferred and evaluated a second time.
    return docs.select(key, F.expr(f"inline(filter(`{spans}`, s -> true))")).select(key, *SPAN_COLUMNS)


def file_name(key: str = "doc_id"):
    return F.concat(F.lit("doc_"), F.col(key).cast("string"), F.lit(".md"))


# --- detection -----------------------------------------------------------------------


def detect_spans(spark, sf):
    return span_rows(detect(documents(spark, sf), overlaps="keep"))


def pii_matches(spark, sf):
    return matches(detect(documents(spark, sf)))


def span_line_col(spark, sf):
    placed = matches(detect(pages(spark, sf)), keep=("page_id",))
    return placed.select("page_id", "start", "entity_type", "line", "column")


def detect_identities(spark, sf):
    """Identity numbers, which the documents do not hold: derived from each customer's key."""
    key = F.col("c_custkey")

    def padded(value, width):
        return F.lpad(value.cast("string"), width, "0")

    account = key + F.lit(370400440532013000)
    check = F.lit(98) - ((account.cast("decimal(38,0)") * 1000000 + 131400) % 97).cast("int")
    rows = table(spark, sf, "customer").select(
        key.alias("c_custkey"),
        "c_name",
        F.concat_ws("-", padded(key % 900, 3), padded(key % 100, 2), padded(key * 7 % 10000, 4)).alias("ssn"),
        F.concat(
            F.lit("9"), padded(key % 100, 2), F.lit("-"), padded(key % 100, 2), F.lit("-"), padded(key % 10000, 4)
        ).alias("itin"),
        padded(key * 7919 % 1000000000, 9).alias("bare"),
        F.concat(
            F.lit("DE"), padded(F.when(key % 3 == 0, 42).otherwise(check), 2), account.cast("string")
        ).alias("iban"),
    )
    text = F.concat(
        F.lit("Tenant "), F.col("c_name"), F.lit("\n"), F.when(key % 2 == 0, "SSN ").otherwise("No. "),
        F.col("ssn"), F.lit(", tax "), F.col("itin"), F.lit("; bare "), F.col("bare"), F.lit(" account "),
        F.col("iban"), F.lit(" end, call 415-555-"), F.substring("bare", 6, 4),
        F.lit("\nborn 19"), padded(key % 80 + 10, 2), F.lit("-02-03, www.example.com/"), F.col("bare"),
        F.lit(", node 2001:db8::"), F.lit(" or ::"), padded(key % 9999, 4), F.lit("; Jürgen"), key.cast("string"),
        F.lit("@bücher.example, "), F.col("ssn"), F.lit(" is an SSN, NHS 943 476 "), padded(key % 9999, 4), F.lit(", mobile 5"), F.col("bare"),
    )
    return span_rows(detect(spread(rows.select("c_custkey", text.alias("text")), "c_custkey")), "c_custkey")


def filter_entities_query(spark, sf):
    return span_rows(filter_entities(detect(documents(spark, sf)), ["EMAIL_ADDRESS", "PHONE_NUMBER"]))


def filter_by_source_list(spark, sf):
    """Each source has its own list of types; sources that end in 9 have none, so all are kept."""
    last = F.right("source", F.lit(1))
    types = F.when(last.isin("0", "2", "4", "6", "8"), F.array(F.lit("EMAIL_ADDRESS"), F.lit("PHONE_NUMBER"))).otherwise(
        F.array(F.lit("CREDIT_CARD"))
    )
    sources = table(spark, sf, "documents").select("source").distinct().where(last != "9")
    allowed = sources.select("source", F.explode(types).alias("entity_type"))
    docs = documents(spark, sf, "doc_id", "text", "source")
    return span_rows(filter_by_list(detect(docs), allowed, "source"))


def resolve_overlaps(spark, sf):
    return span_rows(detect(pages(spark, sf), recognizers=(*RECOGNIZERS, DOMAIN)), "page_id")


# --- counts and reports --------------------------------------------------------------


def entity_counts_query(spark, sf):
    return entity_counts(detect(documents(spark, sf)))


def entity_rollup_query(spark, sf):
    return entity_rollup(detect(documents(spark, sf, "doc_id", "text", "source", "lang")))


def top_docs_by_pii(spark, sf):
    return top_docs(detect(documents(spark, sf)), 20)


def pii_report(spark, sf):
    return report_json(report(detect(documents(spark, sf)), file_name()))


# --- masking -------------------------------------------------------------------------


def mask_redact(spark, sf):
    return mask(detect(documents(spark, sf)), "redact").select("doc_id", "masked")


def mask_anonymize(spark, sf):
    return mask(detect(documents(spark, sf)), "anonymize", salt=SALT).select("doc_id", "masked")


def mask_numbered_query(spark, sf):
    return mask_numbered(detect(documents(spark, sf))).select("doc_id", "masked")


def mask_numbered_corpus(spark, sf):
    """The same text has the same number in all documents."""
    found = written(detect(documents(spark, sf)), "found")
    numbers = number_texts(found.select(F.expr("inline(spans)")))
    return mask_with_numbers(found, written(numbers, "numbers")).select("doc_id", "masked")


def mask_policy(spark, sf):
    policy = {"EMAIL_ADDRESS": "redact", "IP_ADDRESS": "keep"}
    return mask(detect(documents(spark, sf)), "anonymize", policy=policy, salt=SALT).select("doc_id", "masked")


def masked_items(spark, sf):
    masked = mask(detect(documents(spark, sf)), "anonymize", salt=SALT)
    return masked.select("doc_id", F.expr("inline(filter(items, i -> true))"))


def placeholder_counts_query(spark, sf):
    return placeholder_counts(mask(detect(documents(spark, sf)), "anonymize", salt=SALT))


def _encrypted(spark, sf):
    """Masked with one key per language, taken from the column ``lang``."""
    keys = key_ring(spark, {"en": KEY, "de": OTHER_KEY, "fr": KEY, "es": OTHER_KEY})
    docs = documents(spark, sf, "doc_id", "text", "lang")
    return mask(detect(docs), "encrypt", keys=keys, key_id="lang", now=NOW), keys


def mask_encrypt_shape(spark, sf):
    masked, _ = _encrypted(spark, sf)
    shape = F.regexp_replace("masked", MARKER_PATTERN, "{{ENC:$1:token}}")
    return masked.select("doc_id", shape.alias("masked"))


def roundtrip(spark, sf):
    masked, keys = _encrypted(spark, sf)
    return unmask(masked.drop("text", "spans"), keys, key_id="lang").select("doc_id", "text")


def roundtrip_items(spark, sf):
    masked, keys = _encrypted(spark, sf)
    return unmask_items(masked.drop("text", "spans"), keys, key_id="lang").select("doc_id", "text")


def marker_counts(spark, sf):
    masked, keys = _encrypted(spark, sf)
    restored = unmask(masked.drop("text", "spans"), keys, key_id="lang")
    return restored.select("doc_id", "markers_found", "markers_decrypted")


def wrong_key_keeps(spark, sf):
    masked = mask(detect(documents(spark, sf)), "encrypt", keys=key_ring(spark, {"k": KEY}), now=NOW)
    restored = unmask(masked.drop("text", "spans"), key_ring(spark, {"k": OTHER_KEY}))
    return restored.select(
        "doc_id", (F.col("masked") == F.col("text")).alias("unchanged"), "markers_found", "markers_decrypted"
    )


def preserve_roundtrip(spark, sf):
    """Digits encrypted to digits and back; whether all card numbers still pass their test."""
    keys = key_ring(spark, {"k": KEY})
    found = detect(documents(spark, sf), entities=["CREDIT_CARD", "PHONE_NUMBER"])
    masked = mask(found, "preserve", keys=keys)
    cards = F.expr("forall(filter(items, e -> e.entity_type = 'CREDIT_CARD'), e -> luhn_check(regexp_replace(substring(masked, e.start + 1, e.end - e.start), '[^0-9]', '')))")
    back = restore_preserved(masked.withColumn("valid", cards), keys, into="restored")
    alike = F.regexp_replace("masked", "[0-9]", "0") == F.regexp_replace("text", "[0-9]", "0")
    return back.select("doc_id", F.col("restored").alias("text"), "valid", alike.alias("alike"), (F.col("masked") != F.col("text")).alias("changed"))


# when the tokens of a document were made, by its id, and since when each language has which key
MADE = (datetime(2024, 3, 1, tzinfo=timezone.utc), datetime(2024, 8, 1, tzinfo=timezone.utc), datetime(2025, 2, 1, tzinfo=timezone.utc))
SINCE = (datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 7, 1, tzinfo=timezone.utc), datetime(2025, 1, 1, tzinfo=timezone.utc))
THIRD_KEY = "YWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXowMTIzNDU="


def _aged(spark, sf):
    """Documents masked at three times with the keys of those times, and the keys, the first of which Spanish has not."""
    versions = list(zip(SINCE, (KEY, OTHER_KEY, THIRD_KEY), strict=True))
    ring = version_ring(spark, [(lang, since, key) for lang in ("en", "de", "fr", "es") for since, key in versions if (lang, key) != ("es", KEY)])
    found = detect(documents(spark, sf, "doc_id", "text", "lang"))
    parts = [
        mask(found.where(F.col("doc_id") % 3 == k), "encrypt", keys=key_ring(spark, {"k": key}), now=MADE[k])
        for k, (_, key) in enumerate(versions)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("text", "spans"), ring


def key_versions(spark, sf):
    masked, ring = _aged(spark, sf)
    return token_versions(masked, ring, "lang")


def rotate_keys(spark, sf):
    """All tokens encrypted anew under one key, and read with it."""
    masked, ring = _aged(spark, sf)
    keys = key_ring(spark, {"new": THIRD_KEY})
    again = rotate(masked, ring, "lang", keys, NOW).drop("markers_found", "markers_decrypted")
    restored = unmask(again, keys)
    known = F.col("markers_found") == F.col("markers_decrypted")
    return restored.select("doc_id", "markers_found", "markers_decrypted", F.when(known, F.col("text")).alias("text"))


def protect_by_source(spark, sf):
    """The whole job in one stage, then counts by source."""
    docs = documents(spark, sf, "doc_id", "text", "source")
    done = protect(docs, "encrypt", keys=key_ring(spark, {"k": KEY}), now=NOW)
    return done.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("pii_total").alias("spans"),
        F.count_if(F.contains("masked", F.lit("{{ENC:"))).alias("masked_documents"),
    )


# --- text ----------------------------------------------------------------------------


def dirty_text(spark, sf):
    blank_end = F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\u00a0\n"))
    broken = F.replace(blank_end, F.lit(". "), F.lit(".\u3000\r\n\n \n\n"))
    padded = F.concat(F.lit(" "), broken, F.lit("  "))
    odd = F.col("doc_id") % 2 == 1
    text = F.when(odd, F.replace(padded, F.lit("\n"), F.lit("\r\n"))).otherwise(padded)
    return documents(spark, sf).select("doc_id", text.alias("text"))


def normalize_text(spark, sf):
    return dirty_text(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


def assemble_pages_query(spark, sf):
    text = F.when(F.col("turn") % 3 != 2, F.col("text")).alias("text")
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), text
    )
    return assemble_pages(rows)


def first_nonempty(spark, sf):
    case = F.col("doc_id") % 4
    a = F.when(case == 0, F.col("text")).when(case == 1, "")
    b = F.when(case == 1, F.col("text")).when(case == 2, "")
    c = F.when(case == 2, F.col("text")).otherwise("")
    text = tx.first_nonempty(a, b, c)
    return table(spark, sf, "documents").select(
        "doc_id", text.alias("text"), F.when(text.isNull(), "no extractor gave text").alias("error")
    )


def in_path():
    case = F.col("doc_id") % 4
    ext = F.when(case == 0, ".md").when(case == 1, ".PDF").when(case == 2, "").otherwise(".tar.gz")
    return F.concat(F.lit("/in/"), F.col("source"), F.lit("/doc."), F.col("doc_id").cast("string"), ext)


def paths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", in_path().alias("path"))


def output_paths(spark, sf):
    path = F.col("path")
    out = tx.output_path(path)
    return paths(spark, sf).select(
        "doc_id",
        tx.basename(path).alias("base"),
        tx.stem(path).alias("stem"),
        tx.extension(path).alias("ext"),
        tx.output_dir(path).alias("outdir"),
        out.alias("out_path"),
        tx.report_path(out).alias("report_path"),
        tx.decrypted_path(path).alias("decrypted_path"),
    )


def route_by_ext(spark, sf):
    return route(paths(spark, sf)).select("path", "route")


def parse_kv_metadata(spark, sf):
    query = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    extra = F.array(*[F.lit(i) for i in ("flag", "ref=a=b", "site=first", "site=last")])
    items = F.concat(F.split(query, "&"), extra)
    rows = table(spark, sf, "pages").select("page_id", items.alias("items"))
    return rows.select("page_id", F.explode(tx.parse_key_values(F.col("items"))).alias("key", "value"))


# --- files ---------------------------------------------------------------------------


def content_files(spark, sf):
    """Documents as UTF-8 files with ``\\r\\n`` line ends, some with a byte that is not UTF-8."""
    crlf = F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8")
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(crlf, F.unhex(F.lit("FF")))).otherwise(crlf)
    rows = documents(spark, sf, "doc_id", "text", "source")
    return rows.select("doc_id", in_path().alias("path"), content.alias("content"))


def read_docs(spark, sf):
    return decode_documents(content_files(spark, sf)).select("doc_id", "text", "error")


def file_inventory_query(spark, sf):
    """The documents written as one text file per source, listed, and set beside the table again."""
    docs = table(spark, sf, "documents").select("source", "text")
    out = scratch_path(spark, "files")
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("source").write.partitionBy("source").text(out)
    listed = file_inventory(spark, out).where(F.col("path").contains("/part-") & ~F.col("path").endswith(".crc"))
    found = listed.select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), "length")
    files = found.groupBy("source").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return rows.groupBy("source").agg(F.count("*").alias("documents")).join(files, "source")


def read_text_files(spark, sf):
    """The documents written as one text file per source, with Windows line ends, and read as files."""
    docs = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")).alias("value"))
    out = scratch_path(spark, "texts")
    docs.repartition("source").write.partitionBy("source").text(out)
    read = read_documents(spark, out, glob="part-*.txt")
    source = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return read.select(source.alias("source"), F.length("text").cast("long").alias("n_chars"), F.contains("text", F.lit("\r")).alias("returns"), "error")


def extract_text_job(spark, sf):
    """Pages as binary files in two made-up formats, and a third that nothing can read."""
    case = F.col("page_id") % 3
    magic = F.when(case == 0, "A:").when(case == 1, "B:").otherwise("C:")
    content = F.encode(F.concat(magic, F.col("html")), "UTF-8")
    files = spread(table(spark, sf, "pages"), "page_id").select("page_id", content.alias("content"))

    def first(data):
        return data[2:].decode("utf-8") if data.startswith(b"A:") else None

    def second(data):
        if not data.startswith(b"B:"):
            raise ValueError("not this format")
        return data[2:].decode("utf-8")

    return extract_text(files, [("first", first), ("second", second)], keep=("page_id",))


def detect_with_model_query(spark, sf):
    def load():
        """A stand-in for a model: two capitalised words in a row are a person."""
        import re

        pattern = re.compile("[A-Z][a-z]+ [A-Z][a-z]+")
        return lambda texts: [[(m.start(), m.end(), "PERSON", 0.85) for m in pattern.finditer(t)] for t in texts]

    return span_rows(detect_with_model(documents(spark, sf), load, "stub-person-1"), spans="model_spans")


def model_extract_query(spark, sf):
    def load():
        """A stand-in for a generating model: lists the e-mail addresses of the prompt."""
        import json
        import re

        pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
        return lambda prompts, limits, temperature: [
            json.dumps([{"entity": m, "category": "EMAIL"} for m in pattern.findall(p)]) for p in prompts
        ]

    return model_extract(documents(spark, sf), load, "stub-answer-1")


def model_answers(spark, sf):
    found = detect(documents(spark, sf))
    entities = F.transform(
        F.col("spans"), lambda s: F.struct(s["text"].alias("entity"), F.lower(s["entity_type"]).alias("category"))
    )
    case = F.col("doc_id") % 10
    answer = F.when(case == 3, "none").when(case == 7, "[{broken").otherwise(F.to_json(entities))
    return found.withColumn("answer", answer)


def parse_model_entities(spark, sf):
    parsed = parse_entities(model_answers(spark, sf).select("doc_id", "answer"))
    rows = F.expr("posexplode(if(entities IS NULL, array(CAST(NULL AS struct<entity:string,category:string>)), entities))")
    exploded = parsed.select("doc_id", rows.alias("pos", "e"))
    return exploded.select(
        "doc_id", F.when(F.col("e").isNotNull(), F.col("pos")).alias("pos"),
        F.col("e.entity").alias("entity"), F.col("e.category").alias("category"),
    )


def mask_model_answers(spark, sf):
    """Mask what a model found; a broken answer gives no text and an error."""
    parsed = parse_entities(model_answers(spark, sf).select("doc_id", "text", "answer"))
    found = detect(locate_entities(parsed, score=0.5), also="model_spans")
    masked = mask(found, "redact")
    return masked.select("doc_id", "masked", masking_error().alias("error"))


def locate_entities_query(spark, sf):
    parsed = parse_entities(model_answers(spark, sf).select("doc_id", "text", "answer"))
    return span_rows(locate_entities(parsed, score=0.5), spans="model_spans")


def gazetteer_join(spark, sf):
    """Leases made from customers and nations, against their names as dictionary."""
    nation = table(spark, sf, "nation")
    customer = spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    signer = F.concat(F.col("n_name"), F.lit(" Holdings Co"))
    text = F.concat(
        F.lit("Tenant: "), F.col("c_name"), F.lit(" | Signer: "), signer, F.lit(".\nAgent "), F.col("c_name"),
        F.lit(", "), F.col("n_name"), F.lit("."),
    )
    leases = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.alias("text"))
    terms = (
        customer.select(F.col("c_name").alias("term"), F.lit("PERSON").alias("entity_type"))
        .unionByName(nation.select(F.col("n_name").alias("term"), F.lit("LOCATION").alias("entity_type")))
        .unionByName(nation.select(signer.alias("term"), F.lit("ORGANIZATION").alias("entity_type")))
    )
    return dictionary_spans(leases, terms, by="c_custkey").select("c_custkey", "start", "end", "entity_type", "text")


def leased_documents(spark, sf):
    """Each document inside a lease of a customer, and the names in all leases as dictionary."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    customer = spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
    signer = F.concat(F.col("n_name"), F.lit(" Holdings Co"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    docs = documents(spark, sf).withColumn("c_custkey", F.pmod("doc_id", F.lit(max(1, customer.count()))))
    text = F.concat(
        F.lit("Tenant: "), F.col("c_name"), F.lit(" | Signer: "), signer, F.lit(".\n"), F.col("text"), F.lit("\nAgent "),
        F.col("c_name"), F.lit(", "), F.col("n_name"), F.lit("."),
    )
    small = fits_broadcast(named)
    leases = lookup_join(docs, named, "c_custkey", small=small).select("doc_id", text.alias("text"))
    leases = leases if small else written(leases, "leases")  # else the texts are shuffled for each use
    terms = (
        customer.select(F.col("c_name").alias("term"), F.lit("PERSON").alias("entity_type"))
        .unionByName(nation.select(F.col("n_name").alias("term"), F.lit("LOCATION").alias("entity_type")))
        .unionByName(nation.select(signer.alias("term"), F.lit("ORGANIZATION").alias("entity_type")))
    )
    return leases, terms


def detection_scores(spark, sf):
    """Patterns and a dictionary of half the customers, set against the names in all leases."""
    leases, terms = leased_documents(spark, sf)
    half = terms.where("entity_type <> 'PERSON' OR term LIKE '%0' OR term LIKE '%2' OR term LIKE '%4' OR term LIKE '%6' OR term LIKE '%8'")
    found = span_rows(detect(with_dictionary(leases, half), also="dictionary_spans"))
    named = F.regexp_extract_all("text", F.lit(r"Customer#[0-9]+|NATION_[0-9]+ Holdings Co|NATION_[0-9]+"), F.lit(0))
    known = leases.select("doc_id", F.length("text").alias("n"), named.alias("names"))
    tenant, signer = F.col("names")[0], F.col("names")[1]
    agent, place = F.element_at("names", -2), F.element_at("names", -1)
    spans = [
        ("PERSON", F.lit(8), tenant), ("ORGANIZATION", F.length(tenant) + 19, signer),
        ("PERSON", F.col("n") - F.length(place) - F.length(agent) - 3, agent), ("LOCATION", F.col("n") - F.length(place) - 1, place),
    ]
    rows = F.array(*[F.struct(F.lit(t).alias("entity_type"), s.alias("start"), (s + F.length(w)).alias("end")) for t, s, w in spans])
    wanted = found.where(F.col("entity_type").isin("PERSON", "ORGANIZATION", "LOCATION"))
    return scores(wanted, known.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*"))


def mask_all(spark, sf):
    """Patterns and names in one mask, over whole documents."""
    leases, terms = leased_documents(spark, sf)
    found = detect(with_dictionary(leases, terms), also="dictionary_spans")
    return mask(found, "redact").select("doc_id", "masked")


# Parts of made-up names.
FIRST = ("Al", "Bre", "Cor", "Dar", "El", "Fen", "Gus", "Hil", "Ir", "Jor", "Kal", "Lu", "Mar")
LAST = ("ana", "bert", "dis", "ek", "fan", "gard", "ia", "kos", "lo", "mir", "na")
PLACES = ("burg", "field", "ford", "ham", "ton", "ville", "wick")
FIRMS = ("Holdings", "Investors Co", "Partners", "Trust", "Works Ltd")


def named_parties(spark, sf):
    """c_custkey, person, place and firm with made-up names, as many as there are customers."""
    key = F.col("c_custkey")

    def part(words, *steps):
        return F.element_at(F.array(*map(F.lit, words)), (sum((key / F.lit(s)).cast("long") for s in steps) % len(words) + 1).cast("int"))

    person = F.concat(part(FIRST, 1), part(LAST, 13), F.lit(" "), part(FIRST, 143, 3), part(LAST, 7), part(LAST, 29, 2))
    place = F.concat(part(FIRST, 2, 5), part(LAST, 3), part(PLACES, 1))
    firm = F.concat(part(FIRST, 4), part(LAST, 5, 1), F.lit(" "), part(FIRMS, 1, 6))
    customer = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return customer.select("c_custkey", person.alias("person"), place.alias("place"), firm.alias("firm"))


def planted_documents(spark, sf):
    """Documents with a sentence about the parties of a customer; its form depends on the document."""
    parties = named_parties(spark, sf)
    docs = documents(spark, sf).withColumn("c_custkey", F.pmod("doc_id", F.lit(max(1, parties.count()))))
    forms = (
        ("Tenant: ", "person", " | Signer: ", "firm", "."),
        ("Signed by ", "person", " of ", "place", "."),
        ("", "firm", " in ", "place", " pays ", "person", "."),
        ("Please ask ", "person", " at ", "firm", "."),
        ("Agent ", "person", ", ", "place", "."),
    )
    said = [F.concat(*[F.col(p) if k % 2 else F.lit(p) for k, p in enumerate(form)]) for form in forms]
    sentence = F.element_at(F.array(*said), (F.pmod(F.xxhash64("doc_id"), F.lit(len(forms))) + 1).cast("int"))
    early = F.concat(sentence, F.lit("\n"), F.col("text"))
    late = F.concat(F.col("text"), F.lit("\n"), sentence)
    placed = F.when(F.col("doc_id") % 2 == 0, early).otherwise(late)
    small = fits_broadcast(parties)
    planted = lookup_join(docs, parties, "c_custkey", small=small).select("doc_id", "c_custkey", placed.alias("text"))
    return planted if small else written(planted, "planted")


def tagger_of(spark, sf, planted=None):
    """Trained on two thirds of the customers; the names of the others are in no dictionary."""
    parties = named_parties(spark, sf).where("c_custkey % 3 <> 1")
    kinds = {"person": "PERSON", "place": "LOCATION", "firm": "ORGANIZATION"}
    terms = parties.select(F.explode(F.array(*[F.struct(F.col(c).alias("term"), F.lit(t).alias("entity_type")) for c, t in kinds.items()])).alias("t")).select("t.*").distinct()
    docs = planted_documents(spark, sf) if planted is None else planted
    return train_tagger(docs.where("c_custkey % 3 <> 1"), label=lambda picked: with_dictionary(picked, terms, into="spans"))


def tag_names(spark, sf):
    """Names, places and firms in all documents, also those that no dictionary has."""
    docs = planted_documents(spark, sf)
    return span_rows(tag(docs, tagger_of(spark, sf, docs)), spans="tagged_spans")


def mask_names(spark, sf):
    """Patterns and tagged names in one mask."""
    docs = planted_documents(spark, sf)
    found = detect(tag(docs, tagger_of(spark, sf, docs)), also="tagged_spans")
    return mask(found, "redact").select("doc_id", "masked")


# --- retention -----------------------------------------------------------------------

RETENTION_DAYS = 14
RETENTION_PATTERNS = (".md", ".pdf")


def retention_now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def inventory(spark, sf):
    case = F.col("event_id") % 3
    ext = F.when(case == 0, ".md").when(case == 1, ".json").otherwise(".pdf")
    name = F.concat(F.col("event_id").cast("string"), ext)
    path = F.concat_ws("/", F.lit("/data"), "event_type", F.col("user_id").cast("string"), name)
    return table(spark, sf, "events").select("event_id", path.alias("path"), F.col("ts").alias("mtime"))


def _old(spark, sf):
    return retention.old_files(inventory(spark, sf), RETENTION_DAYS, retention_now(), RETENTION_PATTERNS)


def old_files(spark, sf):
    return _old(spark, sf).select("path", F.round("age_days", 6).alias("age_days"))


def retention_plan(spark, sf):
    plan = retention.delete_files(_old(spark, sf))
    return plan.select("path", F.round("age_days", 6).alias("age_days"), "ok", "error")


def retention_summary(spark, sf):
    return retention.deletion_summary(retention.delete_files(_old(spark, sf)))


def retained_rows(spark, sf):
    events = table(spark, sf, "events")
    return retention.retained(events, _old(spark, sf), "event_id").select("event_id", "event_type", "value")


def retained_in_place(spark, sf):
    """The same rows as ``retained_rows``, out of a table whose files were rewritten only where rows had expired."""
    path = scratch_path(spark, "events")
    events = table(spark, sf, "events")
    versioned.create(events, path, per_file=max(100, events.count() // 40))
    gone = _old(spark, sf).where("event_id % 50 < 25").select("event_id")
    versioned.delete_rows(spark, path, gone, "event_id")
    versioned.delete_rows(spark, path, _old(spark, sf).select("event_id"), "event_id")
    return versioned.read(spark, path).select("event_id", "event_type", "value")


def emptied_dirs(spark, sf):
    return retention.emptied_dirs(inventory(spark, sf), retention.expired(3, retention_now()), "/data")


# --- audit ---------------------------------------------------------------------------


def _counted(spark, sf):
    return with_counts(detect(documents(spark, sf))).drop("text", "spans")


def audit_pii(spark, sf):
    out = file_name()
    events = audit.pii_events(_counted(spark, sf), out, "anonymize", out, tx.report_path(out), NOW, USER)
    return audit.event_json(events)


def flat_events(events: DataFrame) -> DataFrame:
    return events.withColumn("entity_counts", F.to_json("entity_counts"))


def job_events(spark, sf):
    """One job per file: whether its bytes could be read decides how it ends."""
    return flat_events(audit.job_events(decode_documents(content_files(spark, sf)), "encrypt", NOW, USER))


def audit_all(spark, sf):
    """Events of all jobs. Spanish documents have no key, so those with findings fail."""
    out = file_name()
    keys = key_ring(spark, {"en": KEY, "de": OTHER_KEY, "fr": KEY})
    found = with_counts(detect(documents(spark, sf, "doc_id", "text", "lang")))
    counted = mask(found, "encrypt", keys=keys, key_id="lang", now=NOW).withColumn("error", masking_error()).drop("text", "spans")
    # the holder of one key restores all documents
    restored = unmask(counted.where("error IS NULL"), key_ring(spark, {"k": KEY}))
    jobs = audit.job_events(decode_documents(content_files(spark, sf)), "encrypt", NOW, USER)
    summary = retention.deletion_summary(retention.delete_files(_old(spark, sf)))
    manifest = upload_manifest(paths(spark, sf), F.lit("masked"))
    return flat_events(
        audit.union_events(
            audit.pii_events(counted, out, "encrypt", out, tx.report_path(out), NOW, USER),
            audit.decrypt_events(restored, out, tx.decrypted_path(out), NOW, USER),
            audit.cleanup_events(summary, "/data", RETENTION_DAYS, True, NOW, USER),
            audit.upload_events(manifest, NOW, USER),
            jobs,
        )
    )


def audit_committed(spark, sf):
    """What readers see of a log after a run that was killed, done again, and done once more, and another run."""
    log = scratch_path(spark, "audit")
    out = file_name()
    events = audit.pii_events(_counted(spark, sf), out, "anonymize", out, tx.report_path(out), NOW, USER)
    audit_log.stage_events(events, log, "masking")  # killed before its commit
    for _ in range(2):
        audit_log.append_events(events, log, "masking")
    summary = retention.deletion_summary(retention.delete_files(_old(spark, sf)))
    audit_log.append_events(audit.cleanup_events(summary, "/data", RETENTION_DAYS, True, NOW, USER), log, "cleanup")
    return flat_events(audit_log.read_events(spark, log))


def upload_manifest_query(spark, sf):
    bucket = F.concat(F.lit("masked-"), (F.col("doc_id") % 3).cast("string"))
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("batch/"), F.col("doc_id").cast("string")))
    metadata = F.array(F.lit("type=draft"), F.lit("oops"), F.lit("type=pii-masked"))
    manifest = upload_manifest(paths(spark, sf), bucket, key, metadata, "aws:kms", "key-1")
    return manifest.select("path", "s3_uri", "encryption", "kms_key_id", F.col("metadata")["type"].alias("kind"))


# --- training rows -------------------------------------------------------------------


def sft_messages(spark, sf):
    found = detect(documents(spark, sf))
    rows = chat_messages(found.select(F.col("text").alias("source_text"), entities_of().alias("entities")))
    return rows.select(
        F.col("messages")[0]["content"].alias("user_content"),
        F.col("messages")[1]["content"].alias("assistant_content"),
        F.array_join(F.col("messages")["role"], ",").alias("roles"),
    )


def sft_train_rows(spark, sf):
    """Chat rows of the split ``train``, written as a folder per split and loaded by name."""
    out = scratch_path(spark, "splits")
    found = written(with_split(detect(documents(spark, sf)), "doc_id"), "split")
    for split in ("train", "test"):
        found.where(F.col("split") == split).drop("split").write.parquet(f"{out}/{split}")
    rows = chat_messages(load_split(spark, out, "train").select(F.col("text").alias("source_text"), entities_of().alias("entities")))
    return rows.select(F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


def sft_base_prompt(spark, sf):
    masked = mask_numbered(detect(documents(spark, sf)))
    return masked.select("doc_id", masking_prompt(F.col("text"), F.col("masked")).alias("prompt"))


def sft_split(spark, sf):
    return with_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


# --- streaming -----------------------------------------------------------------------


def stream_mask(spark, sf):
    """The document table read as a stream of files; the result is what the stream wrote."""
    schema = table(spark, sf, "documents").schema
    stream = table_stream(spark, f"{sf}/documents.parquet", schema)
    out = scratch_path(spark, "stream-mask")

    def anonymize(batch: DataFrame, _now: datetime) -> DataFrame:
        return mask(detect(spread(batch, "doc_id")), "anonymize", salt=SALT)

    query = protect_stream(
        stream, anonymize, f"{out}/documents", f"{out}/audit", f"{out}/checkpoint", "anonymize",
        clock=lambda: NOW, user=USER,
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/documents").select("doc_id", "masked")


def stream_windows(spark, sf):
    """Events as arriving messages, some of them twice; findings by hour, of the hours that have closed."""
    schema = table(spark, sf, "events").select("event_id", "ts", "user_id").schema
    stream = table_stream(spark, f"{sf}/events.parquet", schema)
    octet = lambda c: F.pmod(F.col(c), F.lit(256)).cast("string")
    said = F.concat(F.lit("from 10.0."), octet("user_id"), F.lit("."), octet("event_id"))
    text = F.when(F.col("event_id") % 4 == 0, F.concat(said, F.lit(" by a"), F.col("user_id").cast("string"), F.lit("@b.com"))).otherwise(said)
    copies = F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    messages = stream.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("time"), text.alias("text"), copies.alias("copy"))
    out = scratch_path(spark, "windows")
    count_stream(messages.drop("copy"), f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return read_counts(spark, f"{out}/counts").select(start, "entity_type", "findings", "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "detect_spans": detect_spans,
        "pii_matches": pii_matches,
        "span_line_col": span_line_col,
        "detect_identities": detect_identities,
        "filter_entities": filter_entities_query,
        "filter_by_source_list": filter_by_source_list,
        "resolve_overlaps": resolve_overlaps,
        "entity_counts": entity_counts_query,
        "entity_rollup": entity_rollup_query,
        "top_docs_by_pii": top_docs_by_pii,
        "pii_report": pii_report,
        "mask_redact": mask_redact,
        "mask_anonymize": mask_anonymize,
        "mask_numbered": mask_numbered_query,
        "mask_numbered_corpus": mask_numbered_corpus,
        "mask_policy": mask_policy,
        "masked_items": masked_items,
        "placeholder_counts": placeholder_counts_query,
        "mask_encrypt_shape": mask_encrypt_shape,
        "roundtrip": roundtrip,
        "roundtrip_items": roundtrip_items,
        "marker_counts": marker_counts,
        "wrong_key_keeps": wrong_key_keeps,
        "preserve_roundtrip": preserve_roundtrip,
        "key_versions": key_versions,
        "rotate_keys": rotate_keys,
        "protect_by_source": protect_by_source,
        "normalize_text": normalize_text,
        "assemble_pages": assemble_pages_query,
        "first_nonempty": first_nonempty,
        "output_paths": output_paths,
        "route_by_ext": route_by_ext,
        "parse_kv_metadata": parse_kv_metadata,
        "read_docs": read_docs,
        "file_inventory": file_inventory_query,
        "read_text_files": read_text_files,
        "extract_text_job": extract_text_job,
        "detect_with_model": detect_with_model_query,
        "model_extract": model_extract_query,
        "parse_model_entities": parse_model_entities,
        "locate_entities": locate_entities_query,
        "mask_model_answers": mask_model_answers,
        "gazetteer_join": gazetteer_join,
        "mask_all": mask_all,
        "detection_scores": detection_scores,
        "tag_names": tag_names,
        "mask_names": mask_names,
        "old_files": old_files,
        "retention_plan": retention_plan,
        "retention_summary": retention_summary,
        "retained_rows": retained_rows,
        "retained_in_place": retained_in_place,
        "emptied_dirs": emptied_dirs,
        "audit_pii": audit_pii,
        "audit_all": audit_all,
        "audit_committed": audit_committed,
        "job_events": job_events,
        "upload_manifest": upload_manifest_query,
        "sft_messages": sft_messages,
        "sft_train_rows": sft_train_rows,
        "sft_base_prompt": sft_base_prompt,
        "sft_split": sft_split,
        "stream_mask": stream_mask,
        "stream_windows": stream_windows,
    }
