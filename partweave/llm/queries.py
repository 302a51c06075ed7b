"""One query per operator over its whole table; the digests of the result contract are derived here."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracles, pii
from .common import documents_of, let, SPACE
from .bpe import encode_documents
from .embed_dups import near_duplicate_vectors
from .licenses import header_lines, licence_scan
from .minhash import near_duplicates
from .line_dedup import dedup_lines
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .quality import quality_verdicts
from .suffix_dedup import dedup_substrings
from .secrets import PATTERNS, secret_spans, span_text
from .token_align import align_documents
from .url_lists import capture_keys, host_of, path_of, url_verdicts


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Copies count one by one, as the SQL has it; the pipeline counts contents."""
    return quality_verdicts(documents_of(spark, sf_dir), each_copy=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_words", "kept")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents lie at source/lang/doc_id.  The corpus has no files named LICENSE, so a text that is notices for the
    most part (half of its characters or more) counts as the licence file of its directory."""
    docs = documents_of(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    notices = F.array_join(header_lines(F.coalesce("text", F.lit(""))), "\n")
    mostly = (F.length(notices) > 0) & (2 * F.length(notices) >= F.length("text"))
    return licence_scan(docs, threshold=0.5, is_licence_file=mostly)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(documents_of(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in PATTERNS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(documents_of(spark, sf_dir))
    by_kind = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"], s["start"], s["end"], s["kind"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.span_text(by_kind(F.col("base"))), 256).alias("base_sha256"),
        pii.span_text(by_kind(F.concat("base", "extra"))).alias("spans"))


def op8_embedding_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def url_list_events(pages: DataFrame) -> DataFrame:
    """Dated entries drawn from the crawl's own hosts and paths: a digest of the key picks keys and dates, and hosts
    with a known bad label are listed from 2024-02-01."""
    keys = F.explode(capture_keys(F.coalesce(host_of(F.col("url")), F.lit("")), F.coalesce(path_of(F.col("url")), F.lit(""))))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("k"), i, 1)) - 1
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2023-12-01").cast("timestamp"))
    src = (
        pages.select(keys.alias("k")).filter(F.col("k").like("domain:%.%.%") | F.col("k").like("path:%")).distinct()
        .withColumns({"a": digit(1), "b": digit(2)})
    )
    listed = F.when(F.col("b") % 4 == 0, "reviewed").otherwise("abuse").alias("list_id")
    row = lambda list_id, action, at: (
        list_id, F.split("k", ":", 2)[0].alias("scope"), F.split("k", ":", 2)[1].alias("key"),
        F.lit(action).alias("action"), at.alias("at"))
    picked = src.filter(F.col("a") % 4 == 0)
    bad = src.filter(F.col("k").like("domain:%") & F.col("k").rlike("cheap-pills|spam-farm|free-bets|ads-track"))
    return (
        picked.select(*row(listed, "add", day((F.col("b") * 20).cast("int"))))
        .unionAll(bad.select(*row(F.lit("abuse").alias("list_id"), "add", F.lit("2024-02-01").cast("timestamp"))))
        .unionAll(picked.filter("a >= 8").select(*row(listed, "remove", day((F.col("b") * 20 + 60).cast("int")))))
    )


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    """The crawl has no fetch times; a page counts as fetched on day page_id mod 360 of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_add(
        "DAY", (F.col("page_id") % 360).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    return url_verdicts(captures, url_list_events(pages), {"abuse": "block", "reviewed": "allow"})


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents_of(spark, sf_dir), width=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents_of(spark, sf_dir), k=2, percent=80, miss=1e-6)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents_of(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir).select("doc_id", "text")
    coded = encode_documents(docs, tokenizer_file("byte_bpe_50k.json"), decoded="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_token_align(spark, sf_dir: str) -> DataFrame:
    return align_documents(documents_of(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).drop("groups")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The rule of the contract: in a tenth of the documents, by the checksum of the id, words repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tiled(ws):
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, place(i).cast("int"))), " ")

    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    planted = let(words, lambda ws: F.when(F.size(ws) > 0, tiled(ws)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(documents_of(spark, sf_dir).select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("at"), r["period"].alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = periodic_runs(docs, least=12, collapsed="collapsed").withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.at").alias("start"), F.col("best.length").alias("length"),
        F.col("best.q").alias("period"), F.expr("1000 * best.length div best.q").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents_of(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def registry():
    queries = {f.__name__: f for f in (op1_suffix_dedup, op2_minhash, op3_packing, op4_license_scan, op10_bpe, op5_quality_rules, op6_secret_scan, op7_pii, op8_embedding_dups, op9_url_filters,
                                       op11_token_align, op12_periodic_runs, op13_line_dedup)}
    return queries, {"op2_minhash": oracles.OP2, "op5_quality_rules": oracles.OP5, "op6_secret_scan": oracles.OP6, "op9_url_filters": oracles.OP9, "op13_line_dedup": oracles.OP13}
