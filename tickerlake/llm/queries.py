"""Queries of this subpackage: (spark, sf_dir) -> DataFrame, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.llm import chat, ctw, decontam, fingerprint, licenses, merkle, minhash_dedup, mixing, prefix_trie, suffix_dedup, toxicity, url_filter, warc
from tickerlake.llm.tables import ascii_lower, crc_remainder, table

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
# Hosts with one of these labels are the listed keys.
LISTED_LABELS = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"]


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = url_filter.split_url(F.col("url"))
    universe = pages.select(host.alias("key"))
    listed = F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in LISTED_LABELS]))
    cascade = url_filter.build(universe, listed)
    return url_filter.judge(pages, URL_RULES, cascade).drop("url")


def _dealt_to_layouts(records: DataFrame) -> DataFrame:
    """(conv_id, json): conversations as records of six layouts, by conv_id.

    A layout that cannot hold a conversation (pairs hold a user's and an
    assistant's text; "shared" has its own names for these roles) leaves it to
    "messages". Some layouts get a field that no mapping names.
    """
    t = records.withColumn("t", F.expr("transform(array_sort(transform(turns, m -> struct(m.turn, m.role, m.text))), m -> struct(m.role AS role, m.text AS text))"))
    pair = "size(t) = 2 AND get(t, 0).role <=> 'user' AND get(t, 1).role <=> 'assistant'"
    first, second = "get(t, 0).text", "get(t, 1).text"
    ways = [
        ("true", "named_struct('turns', turns)"),
        ("NOT exists(t, m -> coalesce(lower(m.role), '') IN ('human', 'gpt'))",
         "named_struct('conversations', transform(t, m -> struct(CASE m.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE m.role END AS from, m.text AS value)))"),
        (pair, f"named_struct('prompt', {first}, 'response', {second})"),
        (pair, f"named_struct('output', {second}, 'instruction', {first}, 'input', cast(null AS string))"),
        (pair, f"named_struct('completion', {second}, 'score', 1.5, 'prompt', {first})"),
    ]
    keep = "map('ignoreNullFields', 'false')"
    cases = " ".join(f"WHEN pmod(conv_id, 6) = {k} AND {fits} THEN to_json({made}, {keep})" for k, (fits, made) in enumerate(ways))
    plain = f"to_json(named_struct('lang', 'en', 'messages', transform(t, m -> struct(m.role AS role, m.text AS content, 0 AS weight))), {keep})"
    return t.select("conv_id", F.expr(f"CASE {cases} ELSE {plain} END").alias("json"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    records = _dealt_to_layouts(chat.rows_to_records(rows.unionByName(more)))
    out = chat.format_turns(chat.json_turns(records, "conv_id", "json"), "conv_id")
    turns = out.withColumn("turns", chat.read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled documents of the table outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_remainder("doc_id", 4) != 2)
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "mean", "peak")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.fit(docs))
    return found.select("doc_id", "n_paragraphs", F.size("hits").cast("long").alias("n_notices"), F.array_join("families", ",").alias("families"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, warc.frames_of(index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(table(spark, sf_dir, "documents"))


def op8_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 10) == 0, F.col("lang"), ctw.Options(across=True))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.words_hit("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.spans_of(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = prefix_trie.rebuilt(turns, base, shared.cast("int"), 3)
    return prefix_trie.trie(convs).drop("n_ends")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return merkle.proofs(merkle.tampered(docs, third))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


__all__ = ["ascii_lower", "registry"]
