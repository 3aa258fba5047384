"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, fingerprint, hmm, html, neardup, packing, periodic, quality, sharding, suffixdup, toxicity, whitening
from tessera.llm.cluster import table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trained = hmm.train(docs.where(remainder("doc_id", 10) != 0).select("text"))
    return hmm.score(docs, trained).select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(trained.lexicon.total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def op2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(read(spark, sf_dir, "documents"))


def op3_longest_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.by_text(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": mark}, {"role": "assistant", "content": mark}]})
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(record).alias("record"))
    turns = chat.turns_of_table(read(spark, sf_dir, "conversations")).unionByName(chat.turns_of_records(extra))
    return chat.summary(chat.format_turns(turns))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(t, '([<\[])(\\*(?:/?s>|/?INST\]|/?ANS\]|TURN:|/TURN\]))', '\1\\\2', 'g')) + CASE r WHEN 'user' THEN 22 WHEN 'assistant' THEN 20 ELSE 23 + length(url_encode(r)) END n FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256, CAST(sum(n) AS BIGINT) formatted_chars
FROM e GROUP BY conv_id
"""


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read(spark, sf_dir, "pages"))


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') k FROM d, unnest(range(1, len(w) - least(len(w), 4) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id a, b.doc_id b, count(*) x FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM e JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) c FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, c.c component_id, doc_id = c.c kept FROM d JOIN c ON a = doc_id LEFT JOIN n USING (doc_id)
"""


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        pieces = packing.pack(read(spark, sf_dir, "documents"), file.read())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdup.removed(read(spark, sf_dir, "documents"), length=400, passage=200)
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op9_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') k FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') k FROM d, sizes, unnest(range(1, len(w) - size + 2)) t(i) WHERE len(w) >= size),
hit AS (SELECT DISTINCT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
covered AS (SELECT doc_id, count(DISTINCT p) n FROM hit, unnest(range(i, i + size)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(covered.n, 0) AS BIGINT) n_hit, CAST(coalesce(its.n, 0) AS BIGINT) n_items, sha256(coalesce(its.s, '')) items_sha256, coalesce(covered.n, 0) > 0 contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: Rows whose remainder of the id's CRC-32 by 4 is this one never train the classifier.
HELD_OUT = 2


def remainder(column: str, by: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, quality.Discriminant]:
    """The statistics of all documents, written, and the model learnt from the labels that may train."""
    stats = table(quality.features(docs))
    train = labels.where(remainder("doc_id", 4) != HELD_OUT).select("doc_id", F.col("quality").alias("label")).dropDuplicates(["doc_id", "label"])
    return stats, quality.fit(stats.join(train, "doc_id").select("x", "label"))


def sampled_model(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> quality.Discriminant:
    """The model learnt from about ``sample`` labelled documents at most, drawn by a hash of their ids; statistics are made of those only."""
    train = labels.where(remainder("doc_id", 4) != HELD_OUT).select("doc_id", F.col("quality").alias("label")).dropDuplicates(["doc_id", "label"])
    drawn = F.pmod(F.xxhash64(F.lit("labelled"), F.col("doc_id").cast("bigint")), F.lit(1 << 30)) <= min(1.0, sample / max(1, train.count())) * (1 << 30)
    some = F.broadcast(train.where(drawn))  # about ``sample`` rows at most
    few = docs.where(drawn).select("doc_id", "text").join(some.select("doc_id"), "doc_id", "left_semi")
    return quality.fit(table(quality.features(few).join(some, "doc_id").select("x", "label")))


def op10_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, model = quality_model(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality.score(stats, model).select("doc_id", (remainder("doc_id", 4) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_harmonic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(read(spark, sf_dir, "documents"), tails=periodic.repeated_tail).withColumn("top", periodic.best(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# DuckDB has no CRC-32, so it is made here from its table, a byte at a time.
OP11_SQL = r"""
WITH RECURSIVE shift(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM shift WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) l FROM shift WHERE k = 8),
crc AS (SELECT id, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(id AS VARCHAR), '')]), lambda h, b: xor(h // 256, l[1 + xor(h % 256, b)])), 4294967295) h
  FROM (SELECT DISTINCT doc_id id FROM documents), crc_table),
d AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') w FROM documents JOIN crc ON id = doc_id),
t AS (SELECT doc_id, w, len(w) n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END a, 3 + (h // 10) % 8 z FROM d),
m AS (SELECT doc_id, n, a, 1 + (n - a) // z p, w FROM t),
x AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] v FROM m, unnest(range(n)) u(i)),
g AS (SELECT doc_id, u.q p, u.q * k i FROM m, unnest(range(1, n // 4 + 1)) u(q), unnest(range(n // u.q)) v(k) WHERE n >= 6 AND u.q * k + 2 * u.q < n),
c AS (SELECT DISTINCT doc_id, p FROM g JOIN x a USING (doc_id, i) JOIN x b ON b.doc_id = g.doc_id AND b.i = g.i + p AND b.v = a.v JOIN x e ON e.doc_id = g.doc_id AND e.i = g.i + 2 * p AND e.v = a.v),
e AS (SELECT c.doc_id, p, a.i, a.i - row_number() OVER (PARTITION BY c.doc_id, p ORDER BY a.i) o FROM c JOIN x a ON a.doc_id = c.doc_id JOIN x b ON b.doc_id = c.doc_id AND b.i = a.i + p AND b.v = a.v),
r AS (SELECT doc_id, start, length, min(p) period FROM (SELECT doc_id, p, min(i) start, count(*) + p length FROM e GROUP BY doc_id, p, o) WHERE length >= greatest(6, 4 * p) GROUP BY ALL),
s AS (SELECT doc_id, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) l FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(start + period, start + length)) u(i)),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) l FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) n_runs, start, length, period, 1000 * length // period exponent_milli, sha256(coalesce(s.l, '')) runs_sha256, sha256(coalesce(k.l, '')) collapsed_sha256
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op12_covariance_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=32)
    error = whitening.identity_error(vectors, model) if model else 0.0
    shares = F.array(*(F.lit(float(e)) for e in (model.explained if model else ()))).cast("array<double>")
    return whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, by: int, held_out: int, sample: int) -> DataFrame:
    """text and label of about ``sample`` labelled documents at most that may train, drawn by a hash of their ids."""
    train = labels.where(remainder("doc_id", by) != held_out).select("doc_id", F.col(label).alias("label")).dropDuplicates(["doc_id", "label"])
    drawn = F.pmod(F.xxhash64(F.lit("labelled"), F.col("doc_id").cast("bigint")), F.lit(1 << 30)) <= min(1.0, sample / max(1, train.count())) * (1 << 30)
    some = F.broadcast(train.where(drawn))  # about ``sample`` rows at most
    return docs.where(drawn).select("doc_id", "text").join(some, "doc_id").select("text", "label")


#: Rows whose remainder of the id's CRC-32 by 3 is this one never train the toxicity model.
TOXIC_HELD_OUT = 1


def op13_maximum_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", 3, TOXIC_HELD_OUT, 20_000))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == TOXIC_HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("passages").cast("bigint").alias("n_passages"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: globals()[f"{name.split('_')[0].upper()}_SQL"] for name in queries() if f"{name.split('_')[0].upper()}_SQL" in globals()}
