"""The training-data operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions.spans import let, settled

from . import ann_forest, chat_format, exact_dedup, lexical_search, license_scan, mixing, near_dedup, periodic_runs, quality_crf, secret_scan, sentencepiece_lattice, url_filter, warc
from .common import WORD, drop_path, shared_path, stash, word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the classifier never learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    chain = quality_crf.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    scored = quality_crf.score(docs.select("doc_id", "text"), chain, out="score")
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


#: The conversation that is added: its texts hold control strings of common templates.
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every record is read by the fingerprint of its outline, however long it is
    records = chat_format.from_turn_rows(_table(spark, sf_dir, "conversations")).drop(chat_format.BUILT)
    planted = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(PLANTED_TEXT).alias("prompt"), F.lit(PLANTED_TEXT).alias("response"))).alias("record")
    )
    records = records.unionByName(planted)
    # roles stay as the table has them
    done = chat_format.format_records(records, role_names={}, any_length=True).select("conv_id", "formatted", "loss_mask")
    # all that follows is read back from the formatted text and its mask
    read = done.withColumn("turns", chat_format.parse_formatted(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.transform("loss_mask", lambda m: chat_format.unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("_said"), F.array_join(under, "").alias("_loss")).select(
        "conv_id",
        "n_turns",
        sha(F.col("_said")).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        sha(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"), keep="max")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc-archives")
    warc.write_archives(warc.plan_records(_table(spark, sf_dir, "pages")), path)
    records = warc.read_records(spark, path, contents=False)
    kind, page = warc.header("WARC-Type"), lambda name: F.regexp_extract(warc.header(name), r"^<urn:page:(-?[0-9]+)>$", 1)
    response = F.col("record_type") == "response"
    read = records.select(
        kind.alias("record_type"),
        page("WARC-Record-ID").try_cast("long").alias("page_id"),
        page("WARC-Refers-To").try_cast("long").alias("refers_to"),
        F.col("content_bytes").alias("_bytes"),
        F.col("content_sha256").alias("_digest"),
        warc.header("WARC-Payload-Length").cast("long").alias("_told_bytes"),
        F.regexp_replace(warc.header("WARC-Payload-Digest"), "^sha256:", "").alias("_told_digest"),
    ).select(
        "page_id",
        F.when(response, F.col("_bytes")).otherwise(F.col("_told_bytes")).alias("payload_bytes"),
        F.when(response, F.col("_digest")).otherwise(F.col("_told_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    done = stash(read, "warc-read")
    drop_path(spark, path)
    return done


#: A public vocabulary of 32,000 pieces.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _encoded(spark: SparkSession, sf_dir: str, model: sentencepiece_lattice.Model) -> DataFrame:
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", digest(F.coalesce("text", F.lit(""))).alias("_digest"))
    coded = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, model, carry=["doc_id", "_digest"]), model)
    same = digest(F.col("decoded")) == F.col("_digest")
    return coded.select("doc_id", "n_tokens", "ids", F.length("decoded").cast("long").alias("decoded_chars"), same.alias("round_trip"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = SENTENCEPIECE_MODEL) -> DataFrame:
    return _encoded(spark, sf_dir, sentencepiece_lattice.load_model(model_path))


def sentencepiece_viterbi(spark: SparkSession, sf_dir: str, model_path: str = SENTENCEPIECE_MODEL) -> DataFrame:
    """The same texts and pieces, with the pieces read as a unigram model."""
    return _encoded(spark, sf_dir, sentencepiece_lattice.as_unigram(sentencepiece_lattice.load_model(model_path)))


URL_RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", license_scan.find_licenses(F.col("text")).alias("f"))
    labels_of = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[x["label"] for x in c]))), ",")
    places, spans = F.col("f.places"), F.col("f.spans")
    return found.select(
        "doc_id",
        F.col("f.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places["start"]).alias("first_word"),
        F.array_max(places["start"]).alias("last_word"),
        labels_of(places).alias("base_labels"),
        labels_of(places, spans).alias("labels"),
        F.col("f.score").alias("score"),
        spans.alias("spans"),
    )


def _with_periods(doc_id: Column, text: Column) -> Column:
    """The text; of every tenth document by hash, with words that repeat from some place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), word_count(text)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))

    def planted(s: Column) -> Column:
        original = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")
        return F.array_join(F.transform(s["w"], lambda _, i: F.get(s["w"], original(i))), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & (n > 0), let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), planted)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _with_periods(F.col("doc_id"), F.col("text")).alias("text"))
    found = docs.select("doc_id", periodic_runs.periodic_runs(settled("text")).alias("f"))
    runs = F.col("f.runs")
    # the greatest length; of equal ones the first by start, then period
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("l"), sha(told).alias("runs_sha256"), sha(F.col("f.collapsed")).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        (-F.col("l.before")).alias("start"),
        F.col("l.length").alias("length"),
        (-F.col("l.period")).alias("period"),
        F.floor(1000 * F.col("l.length") / -F.col("l.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


OP1_SQL = r"""
WITH RECURSIVE
words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n
    FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * n >= 80 * (na + nb - n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
"""

OP5_SQL = """
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
    SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
            + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS escaped
    FROM c),
g AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           CAST(sum(escaped) AS BIGINT) AS escaped
    FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256,
       CAST(escaped + n_turns * (length('[ROLE]') + length('[/ROLE]') + length('[/TURN]')) + length('<s>') + length('</s>') AS BIGINT) AS formatted_chars
FROM g
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""


# Character classes as words and terms have them; DuckDB's // rounds down on whole numbers.
OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'),
        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t
    FROM documents),
n AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
q AS (
    SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'),
        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
    FROM benchmark),
words AS (SELECT r, doc_id, n, unnest(t) AS term FROM n),
tf AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM words WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
scored AS (
    SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP8_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
           CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
    FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_nearest, op3_mixing, op4_quality, op5_chat_format, op6_exact_dedup, op7_secret_scan, op8_warc, op9_sentencepiece, op10_url_filter, op11_lexical_search, op12_license_scan, op13_periodic_runs, sentencepiece_viterbi)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op5_chat_format": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_warc": OP8_SQL, "op11_lexical_search": OP11_SQL}
