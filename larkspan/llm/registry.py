"""The thin queries opN_<name> over the sample tables and their DuckDB twins."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import ship
from larkspan.llm.shared import workdir
from larkspan.llm import chat, decontaminate, kneserney, language, licences, media, mixing, neardup, substrings, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator that registers fn(spark, sf_dir)."""

    def put(fn):
        QUERIES[name] = wraps(fn)(lambda spark, sf_dir: fn(ship(spark), sf_dir))
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op8_chat_format",
    r"""WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        sized AS (
          SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE role END AS title,
            2 * length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS escaped FROM rows)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(4 + length(title) + 2 + escaped + 9) AS BIGINT) AS formatted_chars,
          regexp_full_match(string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1] ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid,
          CASE WHEN NOT regexp_full_match(string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1] ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)*u?') THEN 'broken'
            ELSE CASE last(role ORDER BY turn, role, text) WHEN 'system' THEN 'primed' WHEN 'user' THEN 'asked' ELSE 'answered' END END AS end_state
        FROM sized GROUP BY conv_id""",
)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back; whether the roles' order is valid, and the state they end in."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(rows)
    read = out.select(
        "conv_id",
        chat.parse_chats(F.col("formatted")).alias("turns"),
        chat.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "end_state",
    )
    nl = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "end_state",
    )


@query("op1_licence_scan")
def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places, labels and score of every document."""
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


@query("op10_media_columns")
def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a Netpbm or BMP file and read back; digests of both, tile (written as NPY) and difference hash."""
    images = media.text_images(_table(spark, sf_dir, "documents"), uri=workdir(spark, "tiles"))
    return images.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_format", F.sha2("tile_npy", 256).alias("tile_sha256"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at 0.85 over 5-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


@query(
    "op7_warc_normalise",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS winner FROM p)
      SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5) AS INT) >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
        CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
      FROM w""",
)
def op7_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, normalised and read back."""
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_mix_sources")
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words at weights 3, 1, 2."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("text_hash")


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less repeated sentence spans."""
    out = substrings.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "_cut.sentences_removed", "_cut.words_removed")


def _words_sql(column: str) -> str:
    """DuckDB: list of the words with A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"list_filter(regexp_split_to_array(translate(coalesce({column}, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(
    "op3_decontaminate",
    f"""WITH b AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
        d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
        bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
               FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM bs),
        ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
               FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
        n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM bs JOIN ds USING (k, s) GROUP BY ALL)
      SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
      FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles""",
)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item with containment of 0.8 or more."""
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a bigram model of the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneserney.train(docs.filter(~kneserney.held_out_column()))
    return kneserney.score(docs, model, kneserney.held_out_column())
