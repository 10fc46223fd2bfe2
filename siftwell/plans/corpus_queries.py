"""Queries over documents: sources, splits, tokens, packing, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import hashing, ranking, tokens
from siftwell.operators import corpus as C
from siftwell.plans.registry import query
from siftwell.sources import corpora


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def L(c):
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


#: DuckDB: characters that the character vocabulary has, their ids, and the digest of a list.
KEPT = r"regexp_replace(text, '[^\n -~]', '', 'g')"
IDS = f"list_transform(string_split({KEPT}, ''), lambda c: CASE WHEN c = chr(10) THEN 0 ELSE ascii(c) - 31 END)"
FLAT = f"""tok AS (SELECT doc_id, list_append(CASE WHEN length({KEPT}) = 0 THEN []::INT[] ELSE {IDS} END, 96) AS ids FROM documents),
flat AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS pos, id FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS k FROM tok))"""


def windows_sql(size: int, stride: int) -> str:
    return f"""WITH {FLAT}, x AS (SELECT pos // {stride} AS w, pos % {stride} AS k, id FROM flat UNION ALL SELECT pos // {stride} - 1, pos % {stride} + {stride}, id FROM flat WHERE pos % {stride} < {size - stride} AND pos >= {stride})
SELECT w AS "window", max(CASE WHEN k = 0 THEN id END)::BIGINT AS first, max(CASE WHEN k = {size - 1} THEN id END)::BIGINT AS last, sum(id * (k + 1))::BIGINT AS digest
FROM x GROUP BY w HAVING count(*) = {size}"""


@query("split_hash", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '2357', doc_id)), doc_id) <= ceil((SELECT count(*) FROM documents) * 0.1) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_hash(spark, sf_dir):
    return C.random_split(table(spark, sf_dir, "documents").select("doc_id"), 0.1)


@query("split_modulo", "SELECT doc_id, CASE WHEN k <= 6 THEN 'train' WHEN k <= 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 10 AS k FROM documents)")
def split_modulo(spark, sf_dir):
    return C.modulo_split(table(spark, sf_dir, "documents").select("doc_id"))


@query("split_positional", "SELECT doc_id, length(substring(text, 1, floor(length(text) * 0.8)::INT))::BIGINT AS train_chars, md5(substring(text, floor(length(text) * 0.8)::INT + 1)) AS val_md5 FROM documents")
def split_positional(spark, sf_dir):
    a, b = C.positional_split(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", L(F.length(a)).alias("train_chars"), F.md5(b.cast("binary")).alias("val_md5"))


@query("split_predefined", "SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN 'val' ELSE 'train' END AS split FROM documents")
def split_predefined(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").isin("de", "fr"), "val").otherwise("train").alias("split"))


@query("char_tokens", f"WITH {FLAT} SELECT doc_id, len(ids)::BIGINT AS n, list_sum(list_transform(range(1, len(ids) + 1), lambda k: ids[k] * k))::BIGINT AS digest FROM tok")
def char_tokens(spark, sf_dir):
    return C.tokenized(table(spark, sf_dir, "documents")).select("doc_id", L(F.size("ids")).alias("n"), tokens.checksum(F.col("ids")).alias("digest"))


@query("truncate_end", f"WITH {FLAT} SELECT doc_id, least(len(ids) - 1, 100)::BIGINT + 1 AS n, coalesce(list_sum(ids[1:least(len(ids) - 1, 100)]), 0)::BIGINT + 96 AS total FROM tok")
def truncate_end(spark, sf_dir):
    ids = tokens.with_end(tokens.char_ids(F.col("text")), most=100)
    return table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", L(F.size("ids")).alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("pad_to_multiple", f"SELECT doc_id, (ceil((length({KEPT}) + 1) / 1024.0) * 1024)::BIGINT AS padded, (ceil((length({KEPT}) + 1) / 1024.0) * 1024)::BIGINT - length({KEPT}) AS added FROM documents")
def pad_to_multiple(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id", tokens.char_ids(F.col("text")).alias("ids"))
    padded = ids.select("doc_id", tokens.pad_to_multiple(F.col("ids"), 1024).alias("p"), F.size("ids").alias("n"))
    return padded.select("doc_id", L(F.size("p")).alias("padded"), L(F.size("p") - F.col("n")).alias("added"))


@query("begin_end_tokens", f"WITH t AS (SELECT doc_id, CASE WHEN length({KEPT}) = 0 THEN []::INT[] ELSE {IDS} END AS ids FROM documents), b AS (SELECT doc_id, ids, CASE WHEN ids[1] = 53 THEN 0 ELSE 1 END AS nb FROM t) SELECT doc_id, (len(ids) + nb + CASE WHEN coalesce(ids[-1], 53) = 15 THEN 0 ELSE 1 END)::BIGINT AS n FROM b")
def begin_end_tokens(spark, sf_dir):
    ids = tokens.with_bounds(tokens.char_ids(F.col("text")), 53, 15)
    return table(spark, sf_dir, "documents").select("doc_id", L(F.size(ids)).alias("n"))


@query("decode_tokens", f"SELECT doc_id, md5({KEPT}) AS decoded FROM documents")
def decode_tokens(spark, sf_dir):
    ids = tokens.char_ids(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.transform(ids, lambda i: F.when(i == 0, "\n").otherwise(F.chr(i + 31))), "").cast("binary")).alias("decoded"))


@query("template_concat", "SELECT p_partkey, coalesce(p_name, '') || coalesce(p_brand, '') || coalesce(p_type, '') AS text FROM part")
def template_concat(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("support"), F.col("p_brand").alias("question"), F.col("p_type").alias("correct_answer"))
    return corpora.task_text(named, "sciq").select("p_partkey", "text")


@query("choice_lookup", "SELECT p_partkey, coalesce(CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type END, 'None') AS answer FROM part")
def choice_lookup(spark, sf_dir):
    choices = F.map_from_arrays(F.array(*[F.lit(x) for x in "ABC"]), F.array("p_name", "p_brand", "p_type"))
    key = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(choices, key), F.lit("None")).alias("answer"))


@query("index_lookup", "SELECT p_partkey, [p_name, p_brand, p_type][p_size % 3 + 1] AS answer FROM part")
def index_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array("p_name", "p_brand", "p_type"), (F.col("p_size") % 3).cast("int")).alias("answer"))


@query("option_parse", "SELECT p_partkey, p_brand AS a, p_type AS b FROM part")
def option_parse(spark, sf_dir):
    text = F.concat(F.lit("a ) "), "p_brand", F.lit(" , b ) "), "p_type")
    options = tokens.option_map(text)
    return table(spark, sf_dir, "part").select("p_partkey", options["a"].alias("a"), options["b"].alias("b"))


@query("domain_names", "SELECT DISTINCT p_type, translate(p_type || ' (x)/y', '/ ()', '-_') AS file FROM part")
def domain_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", tokens.domain_file(F.concat("p_type", F.lit(" (x)/y"))).alias("file")).distinct()


@query("domain_files", f"WITH n AS (SELECT unnest({list(corpora.DOMAINS)}) AS name, unnest(range({len(corpora.DOMAINS)})) AS k), d AS (SELECT doc_id % {len(corpora.DOMAINS)} AS k, count(*)::BIGINT AS docs FROM documents GROUP BY 1) SELECT name, s AS split, '/pile/' || s || '/' || CASE s WHEN 'val' THEN 'validation' ELSE s END || '-' || translate(name, '/ ()', '-_') || '.bin' AS path, docs FROM n JOIN d USING (k), (SELECT unnest(['train', 'val', 'test']) AS s)")
def domain_files(spark, sf_dir):
    """The files of each domain, with as many documents as are dealt to it."""
    named = F.get(F.array(*[F.lit(d) for d in corpora.DOMAINS]), (F.col("doc_id") % len(corpora.DOMAINS)).cast("int"))
    dealt = table(spark, sf_dir, "documents").groupBy(named.alias("name")).agg(F.count(F.lit(1)).alias("docs"))
    return corpora.domain_files(spark, "/pile").join(dealt, "name")


@query("corpus_registry", "SELECT count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents")
def corpus_registry(spark, sf_dir):
    return corpora.read_corpus(spark, "SlimPajama", f"{sf_dir}/documents.parquet").agg(F.count(F.lit(1)).alias("n"), F.sum(L(F.length("text"))).alias("chars"))


@query("corpus_mix", "SELECT lang, count(*)::BIGINT AS n FROM (SELECT lang FROM documents WHERE source = 'src1' UNION ALL SELECT lang FROM documents WHERE lang = 'de') GROUP BY lang")
def corpus_mix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return corpora.both(d.filter("source = 'src1'"), d.filter("lang = 'de'")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("file_numbers", "SELECT 'iter_' || event_id || '.pt' AS name, event_id AS number FROM events WHERE event_id % 3 <> 0")
def file_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("meta"), F.col("event_id"))).otherwise(F.concat(F.lit("iter_"), F.col("event_id"), F.lit(".pt"))).alias("name"))
    return corpora.numbered_files(e).filter("number is not null")


@query("source_breakdown", "WITH f AS (SELECT CASE page_id % 4 WHEN 0 THEN 'gqa/images/' || page_id || '.jpg' WHEN 1 THEN lpad(page_id::VARCHAR, 12, '0') || '.jpg' WHEN 2 THEN 'vg/' || page_id || '.jpg' ELSE 'page' || page_id || '.png' END AS name FROM pages), k AS (SELECT CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) WHEN regexp_matches(name, '^\\d{12}\\.jpg$') THEN 'coco' ELSE 'other' END AS kind FROM f) SELECT kind, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, kind) AS place, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM k GROUP BY kind")
def source_breakdown(spark, sf_dir):
    """Pages as image files: how many have each source, the most common first. The folder that a name begins with is the source, or what a bare name looks like."""
    k, page = F.col("page_id") % 4, F.col("page_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("gqa/images/"), page, F.lit(".jpg"))).when(k == 1, F.concat(F.lpad(page, 12, "0"), F.lit(".jpg"))).when(k == 2, F.concat(F.lit("vg/"), page, F.lit(".jpg"))).otherwise(F.concat(F.lit("page"), page, F.lit(".png")))
    return C.breakdown(table(spark, sf_dir, "pages").select(name.alias("name")), corpora.image_source(F.col("name")), "kind").withColumn("percent", F.round("percent", 6))


@query("guidance_dropout", "SELECT doc_id, (('0x' || substr(md5(concat_ws(':', '5', doc_id, 'text')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 < 0.1 AS no_text, (('0x' || substr(md5(concat_ws(':', '5', doc_id, 'lang')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 < 0.1 AS no_lang FROM documents")
def guidance_dropout(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[(hashing.hash01(5, F.col("doc_id"), F.lit(c)) < 0.1).alias(f"no_{c}") for c in ("text", "lang")])


@query("image_sizes", "SELECT event_id, (256 * greatest(w, h) // least(w, h))::BIGINT AS long_side FROM (SELECT event_id, 200 + event_id % 300 AS w, 220 + event_id % 170 AS h FROM events) WHERE least(w, h) >= 256")
def image_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 300 + 200).alias("w"), (F.col("event_id") % 170 + 220).alias("h"))
    return e.filter(F.least("w", "h") >= 256).select("event_id", F.expr("256 * greatest(w, h) div least(w, h)").alias("long_side"))


@query("document_offsets", f"SELECT doc_id, len, (sum(len) OVER (ORDER BY doc_id) - len)::BIGINT AS start FROM (SELECT doc_id, (length({KEPT}) + 1)::BIGINT AS len FROM documents)")
def document_offsets(spark, sf_dir):
    return C.document_starts(table(spark, sf_dir, "documents").select("doc_id", (tokens.n_char_ids(F.col("text")) + 1).alias("len")))


@query("pack_overlap", windows_sql(513, 512))
def pack_overlap(spark, sf_dir):
    return C.window_digest(C.pack_windows(table(spark, sf_dir, "documents"), 513, 512))


@query("pack_disjoint", windows_sql(1025, 1025))
def pack_disjoint(spark, sf_dir):
    return C.window_digest(C.pack_windows(table(spark, sf_dir, "documents"), 1025, 1025))


@query("document_chunks", f"""WITH s AS (SELECT doc_id, sum(len) OVER (ORDER BY doc_id) - len AS start, sum(len) OVER () AS total FROM (SELECT doc_id, length({KEPT}) + 1 AS len FROM documents))
SELECT doc_id, (CASE WHEN start <= total - 20001 THEN start ELSE ('0x' || substr(md5(concat_ws(':', '3', doc_id)), 1, 13))::BIGINT % (total - 20001 + 1) END)::BIGINT AS "at" FROM s""")
def document_chunks(spark, sf_dir):
    return C.document_chunks(table(spark, sf_dir, "documents"), 20001, 3)


@query("random_windows", f"WITH n AS (SELECT sum(length({KEPT}) + 1)::BIGINT AS n FROM documents) SELECT doc_id AS draw, (('0x' || substr(md5(concat_ws(':', '11', doc_id)), 1, 13))::BIGINT % (n - 512))::BIGINT AS \"at\" FROM n, documents")
def random_windows(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.sum(tokens.n_char_ids(F.col("text")) + 1).alias("n"))
    draws = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("draw"))
    return draws.join(F.broadcast(n)).select("draw", hashing.hash_mod(11, F.col("n") - 512, "draw").alias("at"))


@query("window_counts", f"WITH n AS (SELECT sum(length({KEPT}) + 1)::BIGINT AS n FROM documents) SELECT n - 512 - 1 AS starts, (n // 512 - 1) // 8 AS batches, n // 513 AS disjoint FROM n")
def window_counts(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.sum(tokens.n_char_ids(F.col("text")) + 1).alias("n"))
    return n.selectExpr("n - 512 - 1 as starts", "(n div 512 - 1) div 8 as batches", "n div 513 as disjoint")


@query("train_val_concat", "SELECT doc_id, is_val FROM (SELECT doc_id, false AS is_val FROM documents WHERE lang = 'en' UNION ALL SELECT item_id, true FROM benchmark)")
def train_val_concat(spark, sf_dir):
    train = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.lit(False).alias("is_val"))
    return corpora.both(train, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("is_val")))


@query("batch_chunks", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 32 AS slot FROM documents")
def batch_chunks(spark, sf_dir):
    return C.batches(table(spark, sf_dir, "documents").select("doc_id"), 32, ["doc_id"], "doc_id")


@query("candidate_steps", "SELECT doc_id, b // 2 AS step FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS b FROM documents)")
def candidate_steps(spark, sf_dir):
    return C.batches(table(spark, sf_dir, "documents").select("doc_id"), 16, ["doc_id"], "doc_id").select("doc_id", F.expr("batch div 2").alias("step"))


@query("chunk_divisor", "SELECT p_partkey, p_size * 2 AS batch, 1 + p_partkey % 24 AS asked, d AS chunk, round(d / (p_size * 2)::DOUBLE, 9) AS loss_scale FROM (SELECT p_partkey, p_size, (SELECT max(d) FROM range(1, 25) t(d) WHERE d <= 1 + p_partkey % 24 AND (p_size * 2) % d = 0) AS d FROM part)")
def chunk_divisor(spark, sf_dir):
    """Parts as batches that are cut into chunks of the largest size, up to the one asked for, that divides them; the share of the loss that a chunk has."""
    asked = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2).alias("batch"), (F.col("p_partkey") % 24 + 1).alias("asked"))
    found = asked.withColumn("chunk", C.chunk_size(F.col("batch"), F.col("asked")))
    return found.withColumn("loss_scale", F.round(F.col("chunk") / F.col("batch"), 9))


@query("epoch_permutation", "SELECT e AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws(':', (7 + e)::VARCHAR, doc_id)), doc_id) - 1 AS place FROM documents, range(3) x(e)")
def epoch_permutation(spark, sf_dir):
    """The documents in the order of each of three epochs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("epoch"))
    key = F.md5(F.concat_ws(":", (F.col("epoch") + 7).cast("string"), F.col("doc_id").cast("string")))
    ranked = ranking.running_sum(rows.withColumn("key", key), ranking.hash_bucket("key"), ["key", "doc_id"], F.lit(1), "place", ["epoch"])
    return ranked.select("epoch", "doc_id", "place")


@query("step_slices", "SELECT event_id, event_id // 4 AS step, event_id % 4 AS rank, event_id // 100 AS epoch, event_id % 100 * 8 AS first FROM events")
def step_slices(spark, sf_dir):
    """Events as the batches that four ranks read step by step; an epoch has a hundred."""
    b = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 4").alias("step"), (b % 4).alias("rank"), F.expr("event_id div 100").alias("epoch"), (b % 100 * 8).alias("first"))


@query("draws_with_replacement", "SELECT vec_id, vec_id // 8 AS step, vec_id % 8 AS slot, ('0x' || substr(md5(concat_ws(':', '13', vec_id // 8, vec_id % 8)), 1, 13))::BIGINT % (SELECT count(*) FROM embeddings) AS row FROM embeddings")
def draws_with_replacement(spark, sf_dir):
    """As many draws of vectors as there are, in batches of eight."""
    e = table(spark, sf_dir, "embeddings")
    n = F.broadcast(e.agg(F.count(F.lit(1)).alias("n")))  # one row
    drawn = e.select("vec_id", F.expr("vec_id div 8").alias("step"), (F.col("vec_id") % 8).alias("slot")).join(n)
    return drawn.withColumn("row", hashing.hash_mod(13, F.col("n"), "step", "slot")).drop("n")


SEQ, BATCH, WORLD = 512, 8, 4
#: Start positions (len) of a corpus's windows, and how many windows an epoch has: one less, so that each epoch may begin elsewhere.
LEN = f"len AS (SELECT greatest(sum(length({KEPT}) + 1) - {SEQ} - 1, 0)::BIGINT AS len FROM documents), wn AS (SELECT len, greatest(len // {SEQ} - 1, 0) AS windows, greatest(len // {SEQ} - 1, 0) // {BATCH} AS batches FROM len)"


def window_starts(docs: DataFrame) -> tuple[int, int]:
    """How many start positions and how many windows of an epoch the tokens of ``docs`` have."""
    tokens_in_all = docs.agg(F.sum(tokens.n_char_ids(F.col("text")) + 1)).first()[0] or 0
    starts = max(tokens_in_all - SEQ - 1, 0)
    return starts, max(starts // SEQ - 1, 0)


@query("epoch_windows", f"""WITH {LEN}, p AS (SELECT e, w, row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws(':', (7 + e)::VARCHAR, w)), w) - 1 AS place, batches FROM wn, range(3) x(e), range((SELECT windows FROM wn)) y(w)),
b AS (SELECT *, CASE WHEN place // {BATCH} < batches THEN e * batches + place // {BATCH} END AS b FROM p)
SELECT e AS epoch, w, place, w * {SEQ} + ('0x' || substr(md5(concat_ws(':', '7', e, 'offset')), 1, 13))::BIGINT % {SEQ} AS start, b // {WORLD} AS step, b % {WORLD} AS rank FROM b""")
def epoch_windows(spark, sf_dir):
    """Every window of the corpus once an epoch, shuffled and shifted by the epoch's offset; step and rank that read it, null for the remainder of an epoch."""
    _, windows = window_starts(table(spark, sf_dir, "documents"))
    batches = windows // BATCH
    rows = spark.range(windows).withColumnRenamed("id", "w").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    key = F.md5(F.concat_ws(":", (F.col("epoch") + 7).cast("string"), F.col("w").cast("string")))
    ranked = ranking.running_sum(rows.withColumn("key", key), ranking.hash_bucket("key"), ["key", "w"], F.lit(1), "place", ["epoch"])
    b = F.when(F.col("place") < batches * BATCH, F.col("epoch") * batches + F.expr(f"place div {BATCH}"))
    start = F.col("w") * SEQ + hashing.hash_mod(7, SEQ, "epoch", F.lit("offset"))
    return ranked.withColumn("b", b).select("epoch", "w", "place", start.alias("start"), F.expr(f"b div {WORLD}").alias("step"), (F.col("b") % WORLD).alias("rank"))


@query("window_draws", f"WITH {LEN} SELECT step, slot, ('0x' || substr(md5(concat_ws(':', '13', step, slot)), 1, 13))::BIGINT % len AS start FROM wn, range((SELECT batches FROM wn)) a(step), range({BATCH}) b(slot)")
def window_draws(spark, sf_dir):
    """As many batches as an epoch has, drawn with replacement from all start positions of the corpus."""
    starts, windows = window_starts(table(spark, sf_dir, "documents"))
    grid = spark.range(windows // BATCH).withColumnRenamed("id", "step").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BATCH - 1).cast("bigint"))))
    return grid.withColumn("start", hashing.hash_mod(13, starts, "step", "slot"))


@query("rank_shards", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents")
def rank_shards(spark, sf_dir):
    ranked = ranking.global_rank(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", ["doc_id"])
    return ranked.select("doc_id", ((F.col("rn") - 1) % 4).alias("shard"))


@query("node_shards", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 3 AS node, ((row_number() OVER (ORDER BY doc_id) - 1) // 3) % 4 AS rank FROM documents")
def node_shards(spark, sf_dir):
    """Documents dealt to three nodes in turn, and within a node to its four ranks."""
    k = F.col("rn") - 1
    return ranking.global_rank(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", ["doc_id"]).select("doc_id", (k % 3).alias("node"), (F.floor(k / 3) % 4).alias("rank"))


@query("rank_batches", "SELECT p_partkey, 1 + p_partkey % 16 AS world, CASE WHEN (p_size * 8) % (1 + p_partkey % 16) = 0 THEN p_size * 8 // (1 + p_partkey % 16) END AS batch, gcd(p_size::BIGINT, 1 + p_partkey % 16) AS ranks_by_steps, p_size // gcd(p_size::BIGINT, 1 + p_partkey % 16) AS steps FROM part")
def rank_batches(spark, sf_dir):
    """Parts as runs: batches dealt to ranks (null where they can't be dealt evenly), and accumulation steps by their common divisor with the ranks."""
    runs = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 16 + 1).alias("world"))
    common = C.common_divisor(F.col("p_size").cast("bigint"), F.col("world"))
    dealt = runs.withColumn("batch", F.when(F.col("p_size") * 8 % F.col("world") == 0, F.expr("p_size * 8 div world"))).withColumn("ranks_by_steps", common)
    return dealt.select("p_partkey", "world", "batch", "ranks_by_steps", F.expr("p_size div ranks_by_steps").alias("steps"))


@query("task_quota", "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '17', doc_id)), doc_id) AS rank FROM documents) WHERE rank <= greatest(1, 100 // (SELECT count(DISTINCT lang) FROM documents))")
def task_quota(spark, sf_dir):
    return C.task_quota(table(spark, sf_dir, "documents").select("lang", "doc_id"), 100, 17, "lang", "doc_id")


@query("interleave", "WITH q AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '17', doc_id)), doc_id) AS rank FROM documents) SELECT lang, doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '18', doc_id)), doc_id) AS place FROM q WHERE rank <= greatest(1, 100 // (SELECT count(DISTINCT lang) FROM documents))")
def interleave(spark, sf_dir):
    chosen = C.task_quota(table(spark, sf_dir, "documents").select("lang", "doc_id"), 100, 17, "lang", "doc_id").withColumn("key", hashing.hex_key(18, "doc_id"))
    return ranking.global_rank(chosen, ranking.hash_bucket("key"), ["key", "doc_id"], "place").select("lang", "doc_id", "place")


@query("token_budget", """WITH c AS (SELECT source, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source), e AS (SELECT *, size * 1000003.0::DOUBLE / sum(size) OVER () AS x FROM c), f AS (SELECT *, floor(x)::BIGINT AS fl, round(x - floor(x), 9) AS rest FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS rk, 1000003 - sum(fl) OVER () AS lft FROM f) SELECT source, least(fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END, size)::BIGINT AS tokens FROM r""")
def token_budget(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    return C.largest_remainder(counts, 1000003, "source", "size")


@query("budget_cut", "WITH b AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents), t AS (SELECT batch, sum(sum(n_chars)) OVER (ORDER BY batch) - sum(n_chars) AS before FROM b GROUP BY batch) SELECT doc_id, n_chars, batch FROM b JOIN t USING (batch) WHERE before < 300000")
def budget_cut(spark, sf_dir):
    return C.budget_cut(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 300000, 50, "doc_id", "n_chars").select("doc_id", "n_chars", "batch")


@query("topic_filter", "SELECT source = 'src3' AS topic, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def topic_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy((F.col("source") == "src3").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("proxy_schedule", "SELECT event_id AS iter, event_id > 0 AND event_id % 25 = 0 AS refresh, 42 + 10000 * (event_id // 25) AS seed, greatest(1, (event_id + 31) // 32) AS batches FROM events")
def proxy_schedule(spark, sf_dir):
    """Events as steps: when the proxy set is drawn anew, by which seed, and how many batches a set of as many samples has."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("iter"), ((i > 0) & (i % 25 == 0)).alias("refresh"), (F.expr("event_id div 25") * 10000 + 42).alias("seed"), F.greatest(F.lit(1).cast("bigint"), F.expr("(event_id + 31) div 32")).alias("batches"))


@query("infinite_loop", "SELECT e AS epoch, doc_id FROM documents, range(3) t(e)")
def infinite_loop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("epoch"), "doc_id")


@query("domain_counts", "SELECT source, lang, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_doc, sum(strlen(text))::BIGINT // 2 AS tokens_of_file FROM documents GROUP BY source, lang")
def domain_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"), F.floor(F.sum(F.octet_length("text")) / 2).cast("bigint").alias("tokens_of_file"))


@query("domain_groups", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def domain_groups(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"))
