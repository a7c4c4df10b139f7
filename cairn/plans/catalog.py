"""Named queries over the driver's tables, one or more for each kind of operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import answers, assistant, embed, privacy, text, vectors
from cairn.operators import chunks, events, ingest, search, signals, store
from cairn.sources import extract, mail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; sql is what DuckDB must return for it, if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---------------------------------------------------------------- vectors

_EMB = "embedding::DOUBLE[]"
_Q0 = f"(SELECT {_EMB} FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity({_EMB}, {_Q0})"


def first_vector(emb: DataFrame) -> list[float]:
    return list(emb.where("vec_id = 0").first()["embedding"])


@query("vec_topk", f"SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id)::INTEGER AS rank FROM embeddings ORDER BY rank LIMIT 5")
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return search.top_k(emb, first_vector(emb)).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("vec_topk_batch", f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.{_EMB}, r.{_EMB}) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.{_EMB}, r.{_EMB}) DESC, r.vec_id)::INTEGER AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def vec_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return search.top_k_batch(emb.where("vec_id % 50 = 0"), emb).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_norm", f"SELECT vec_id, round(sqrt(list_inner_product({_EMB}, {_EMB})), 6) AS norm FROM embeddings")
def vec_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("vec_dot", f"SELECT vec_id, round(list_inner_product({_EMB}, {_Q0}), 6) AS dot FROM embeddings")
def vec_dot(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select("vec_id", F.round(vectors.dot(F.col("embedding"), vectors.literal(first_vector(emb))), 6).alias("dot"))


@query("vec_normalize", f"SELECT vec_id, i::INTEGER AS i, round(x / n, 6) AS x FROM (SELECT vec_id, sqrt(list_inner_product({_EMB}, {_EMB})) AS n, unnest(range(len(embedding))) AS i, unnest({_EMB}) AS x FROM embeddings)")
def vec_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.normalise(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query("vec_partition_merge", f"""WITH p AS (SELECT vec_id, label, {_COS} AS s, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings)
SELECT vec_id, label, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INTEGER AS rank FROM p WHERE r <= 5 ORDER BY rank LIMIT 5""")
def vec_partition_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Top k of each label, merged."""
    emb = table(spark, sf, "embeddings")
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    local = search.scored(emb, first_vector(emb)).withColumn("r", F.row_number().over(w)).where("r <= 5")
    best = local.orderBy(F.desc("score"), "vec_id").limit(5)
    return best.select("vec_id", "label", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"))


_ODD = "SELECT CASE vec_id % 3 WHEN 0 THEN embedding WHEN 1 THEN embedding[:32] ELSE list_transform(embedding, lambda x: 0::FLOAT) END AS e, vec_id FROM embeddings"


@query("vec_guard", f"SELECT vec_id, round(list_cosine_similarity(e::DOUBLE[], {_Q0}), 6) AS score FROM ({_ODD}) WHERE vec_id % 3 = 0")
def vec_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of another dimension and of length 0 have no score."""
    emb = table(spark, sf, "embeddings")
    odd = F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 32)).otherwise(F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
    return search.scored(emb.select("vec_id", odd.alias("embedding")), first_vector(emb)).select("vec_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- store


@query("store_get", "SELECT vec_id, label, len(embedding)::INTEGER AS dims FROM embeddings WHERE vec_id IN (3, 77, 450)")
def store_get(spark: SparkSession, sf: str) -> DataFrame:
    return store.get(table(spark, sf, "embeddings"), [3, 77, 450], "vec_id").select("vec_id", "label", F.size("embedding").alias("dims"))


@query("store_stats", "SELECT count(*) AS records, max(vec_id) + 1 AS next_id, sum(84 + 4 * len(embedding) + strlen(label::VARCHAR))::BIGINT AS bytes, count(DISTINCT label) AS labels FROM embeddings")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    size = store.record_size(F.col("embedding"), F.col("label").cast("string"))
    return emb.agg(F.count("*").alias("records"), (F.max("vec_id") + 1).alias("next_id"), F.sum(size).alias("bytes"), F.countDistinct("label").alias("labels"))


@query("store_recover", "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN 'segment' ELSE 'log' END AS origin FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0")
def store_recover(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with two thirds of the records, a log with half of them."""
    emb = table(spark, sf, "embeddings").select("vec_id")
    return store.recovered(emb.where("vec_id % 3 <> 0").withColumn("origin", F.lit("segment")), emb.where("vec_id % 2 = 0").withColumn("origin", F.lit("log")), "vec_id")


@query("block_index", "SELECT block::BIGINT AS block, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS count FROM (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 128 AS block FROM embeddings) GROUP BY block")
def block_index(spark: SparkSession, sf: str) -> DataFrame:
    return store.block_index(table(spark, sf, "embeddings"), "vec_id")


# ---------------------------------------------------------------- chunks and tokens

_CHUNKS = """WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS ln, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
w AS (SELECT doc_id, ln, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w FROM (SELECT doc_id, ln, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS ws FROM l)),
e AS (SELECT doc_id, list(w ORDER BY ln, j) AS ws, list(ln ORDER BY ln, j) AS lns, count(*) AS n FROM w GROUP BY doc_id),
k AS (SELECT *, unnest(range(0, CASE WHEN n <= 500 THEN 0 ELSE ceil((n - 500) / 420.0)::BIGINT END + 1)) AS c FROM e),
p AS (SELECT doc_id, c, ws[c * 420 + 1:c * 420 + 500] AS ws, lns[c * 420 + 1:c * 420 + 500] AS lns FROM k),
chunks AS (SELECT doc_id, c::INTEGER AS chunk_no, lns[1]::INTEGER AS start_line, lns[len(lns)]::INTEGER AS end_line, sha256(doc_id || ':' || lns[1] || ':' || lns[len(lns)]) AS chunk_id, sha256(array_to_string(ws, ' ')) AS content_hash FROM p)
"""


@query("doc_chunks", _CHUNKS + "SELECT * FROM chunks")
def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").drop("text")


@query("chunk_id_collisions", _CHUNKS + "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1")
def chunk_id_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return doc_chunks(spark, sf).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


_TOK = f"list_filter(regexp_split_to_array(lower({{}}), '[^a-z]+'), lambda x: length(x) > 2 AND x NOT IN ({names(text.STOP_WORDS)}))"


@query("tf_vocab", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY token")
def tf_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return embed.vocabulary(table(spark, sf, "documents"))


@query("tf_topk", f"""WITH a AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY ALL),
b AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({_TOK.format('text')}) AS token FROM benchmark) GROUP BY ALL),
u AS (SELECT doc_id, token, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM a), v AS (SELECT item_id, token, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS y FROM b),
s AS (SELECT item_id, doc_id, round(sum(x * y), 6) AS score FROM u JOIN v USING (token) GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) WHERE rank <= 3""")
def tf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """For each test item the three documents whose token counts are most similar."""
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]  # the questions asked
    near = search.top_k_terms(items, table(spark, sf, "documents"), 3, text.STOP_WORDS)
    return near.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


_KEYS = ["the", "est", "und", "ing", "tion", "que", "license"]


@query("keyword_embed", "WITH k AS (SELECT doc_id, unnest(range(7)) AS i, unnest([" + ", ".join(f"contains(lower(text), '{k}')::INTEGER" for k in _KEYS) + "]) AS h FROM documents) SELECT doc_id, i::INTEGER AS i, round(h / greatest(1, sqrt(sum(h) OVER (PARTITION BY doc_id))), 6) AS x FROM k")
def keyword_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(embed.keywords(F.col("text"), _KEYS)).alias("i", "x")).select("doc_id", "i", F.round("x", 6).alias("x"))


_DRAW = f"((s::UHUGEINT * {embed._A} + {embed._C}) % 18446744073709551616)::UHUGEINT"


@query("mock_embed", f"""WITH RECURSIVE b AS (SELECT item_id, sha256(text) AS h FROM benchmark WHERE text IS NOT NULL),
b0 AS (SELECT item_id, list_reduce(list_prepend(0::UHUGEINT, list_transform(range(32), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UHUGEINT)), lambda a, x: (a * 31 + x) % 18446744073709551616) AS s FROM b),
d(item_id, i, s) AS (SELECT item_id, 0, {_DRAW} FROM b0 UNION ALL SELECT item_id, i + 1, {_DRAW} FROM d WHERE i < 383),
v AS (SELECT item_id, i, ((s // 8589934592)::DOUBLE / 2147483648)::FLOAT::DOUBLE AS x FROM d)
SELECT item_id, i::INTEGER AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM v""")
def mock_embed(spark: SparkSession, sf: str) -> DataFrame:
    vectors_ = table(spark, sf, "benchmark").select("item_id", F.posexplode(embed.hashed_udf("text")).alias("i", "x"))
    return vectors_.select("item_id", "i", F.round("x", 6).alias("x"))


@query("retrieval_accuracy", f"""WITH s AS (SELECT q.vec_id, q.label = r.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.{_EMB}, r.{_EMB}) DESC, r.vec_id) AS rank
FROM embeddings q, embeddings r WHERE q.vec_id <> r.vec_id AND q.vec_id % 50 = 0), t AS (SELECT vec_id, bool_or(hit AND rank = 1) AS one, bool_or(hit) AS three FROM s WHERE rank <= 3 GROUP BY vec_id)
SELECT count(*) AS questions, round(avg(one::INTEGER), 6) AS top1, round(avg(three::INTEGER), 6) AS top3 FROM t""")
def retrieval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often the nearest neighbours of a query (itself apart) bear its label."""
    emb = table(spark, sf, "embeddings")
    near = search.top_k_batch(emb.where("vec_id % 50 = 0"), emb, k=4).where("query_id <> id")
    label = emb.select("vec_id", "label")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    hit = near.withColumn("rank", rank).where("rank <= 3").join(label.toDF("query_id", "l"), "query_id").join(label.toDF("id", "m"), "id").select("query_id", "rank", (F.col("l") == F.col("m")).alias("hit"))
    per = hit.groupBy("query_id").agg(F.bool_or(F.col("hit") & (F.col("rank") == 1)).alias("one"), F.bool_or("hit").alias("three"))
    return per.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("one").cast("int")), 6).alias("top1"), F.round(F.avg(F.col("three").cast("int")), 6).alias("top3"))


# ---------------------------------------------------------------- ingestion and privacy

_FOLDERS, _NAMES = ["src", "a/b", ".git/x", "node_modules", "config", "work/.ssh"], ["notes", "bank_jan", ".env", "id_rsa", "secrets", "report", "password"]
_EXTS = [".md", ".txt", ".pem", ".exe", ".html", ".yml", "", ".PDF"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each document: its path, size and guards derive from the id."""
    i = F.col("doc_id").cast("int")
    part = lambda vs, d: F.element_at(F.array(*map(F.lit, vs)), (F.floor(i / d) % len(vs) + 1).cast("int"))
    path = F.concat(F.lit("root/"), part(_FOLDERS, 1), F.lit("/"), part(_NAMES, 2), part(_EXTS, 3))
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", path.alias("path"), (F.length("text").cast("long") * F.when(i % 17 == 0, 1_000_000).otherwise(1)).alias("size"), (i % 23).alias("depth"),
        (i % 29 == 0).alias("is_symlink"), (i % 31 != 0).alias("inside"), F.sha2("text", 256).alias("hash"), F.col("text").alias("content"),
    )


def _pick(vs: list[str], d: int) -> str:
    return f"list_element([{names(vs)}], ((doc_id // {d}) % {len(vs)} + 1)::INTEGER)"


_FILES = f"""f AS (SELECT doc_id, 'root/' || {_pick(_FOLDERS, 1)} || '/' || {_pick(_NAMES, 2)} || {_pick(_EXTS, 3)} AS path, (length(text) * CASE WHEN doc_id % 17 = 0 THEN 1000000 ELSE 1 END)::BIGINT AS size,
(doc_id % 23)::INTEGER AS depth, doc_id % 29 = 0 AS is_symlink, doc_id % 31 <> 0 AS inside, sha256(text) AS hash, text AS content FROM documents)"""
_WHOLE, _PART = ("|".join(privacy.glob_regex(p) for p in g) for g in (privacy.DENY_FILES, privacy.DENY_FOLDERS))
_BASE = "string_split(path, '/')[-1]"
_DENIED = f"(regexp_matches({_BASE}, '^({_WHOLE})$') OR regexp_matches(path, '^[^/]*/({_WHOLE})$') OR regexp_matches(path, '(^|/)({_PART})(/|$)'))"
_EXT = f"lower(regexp_extract(path, '(\\.[^./]*)$', 1))"


@query("deny_filter", f"WITH {_FILES} SELECT doc_id, path, {_DENIED} AS denied FROM f")
def deny_filter(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("doc_id", "path", privacy.denied(F.col("path")).alias("denied"))


@query("ext_filter", f"WITH {_FILES} SELECT doc_id, {_EXT} AS ext, {_EXT} IN ({names(privacy.SUPPORTED)}) AS supported, {_EXT} IN ({names(privacy.BINARY)}) AS binary FROM f")
def ext_filter(spark: SparkSession, sf: str) -> DataFrame:
    ext = text.extension(F.col("path"))
    return files(spark, sf).select("doc_id", ext.alias("ext"), ext.isin(*privacy.SUPPORTED).alias("supported"), ext.isin(*privacy.BINARY).alias("binary"))


@query("depth_filter", f"WITH {_FILES} SELECT doc_id, (len(string_split(substring(path, 6), '/')) - 1)::INTEGER AS depth, size > {privacy.MAX_FILE} AS too_large FROM f")
def depth_filter(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("doc_id", text.depth(F.col("path"), F.lit("root")).cast("int").alias("depth"), (F.col("size") > privacy.MAX_FILE).alias("too_large"))


@query("allow_filter", f"WITH {_FILES} SELECT doc_id, starts_with(path, 'root/a/') AND NOT starts_with(substring(path, 8), '..') AS allowed FROM f")
def allow_filter(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("doc_id", privacy.allowed(F.col("path"), F.lit("root/a")).alias("allowed"))


def _secret(t: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in privacy.SECRETS) + "], lambda x: x IS NOT NULL)"


_DECIDE = f"""d AS (SELECT *, CASE WHEN depth > 20 THEN 'skipped_depth' WHEN is_symlink THEN 'skipped_symlink' WHEN {_EXT} IN ({names(privacy.BINARY)}) OR {_EXT} NOT IN ({names(privacy.SUPPORTED)}) THEN 'ignored'
WHEN size > {privacy.MAX_FILE} THEN 'skipped_too_large' WHEN NOT inside THEN 'skipped_not_allowed' WHEN {_DENIED} THEN 'skipped_denylist' WHEN (path, hash) IN (SELECT (path, hash) FROM f WHERE doc_id % 5 = 0) THEN 'skipped_unchanged'
WHEN len({_secret('content')}) > 0 THEN 'skipped_secret' ELSE 'indexed' END AS event FROM f)"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """The files against a snapshot of every fifth of them."""
    f = files(spark, sf)
    return ingest.decide(f, f.where("doc_id % 5 = 0").select("path", "hash"))


@query("file_events", f"WITH {_FILES}, {_DECIDE} SELECT doc_id, event FROM d")
def file_events(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).select("doc_id", "event")


@query("index_counters", f"""WITH {_FILES}, {_DECIDE} SELECT count(*) FILTER (event NOT IN ('skipped_depth', 'skipped_symlink', 'ignored')) AS total, count(*) FILTER (event = 'indexed') AS indexed,
count(*) FILTER (event NOT IN ('skipped_depth', 'skipped_symlink', 'ignored', 'indexed')) AS skipped, count(*) FILTER (event = 'skipped_secret') AS skipped_secret,
count(*) FILTER (event IN ('skipped_not_allowed', 'skipped_denylist')) AS skipped_denied FROM d""")
def index_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.counters(decided(spark, sf))


@query("audit_counts", f"WITH {_FILES}, {_DECIDE} SELECT event, count(*) AS n FROM d WHERE event <> 'ignored' GROUP BY event")
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.audit_rows(decided(spark, sf)).groupBy("event").agg(F.count("*").alias("n"))


@query("file_diff", """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS path, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (doc_id)""")
def file_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    now = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return ingest.diff(docs.where("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("hash")), docs.where("doc_id % 7 <> 0").select("path", F.sha2(now, 256).alias("hash")))


@query("secret_scan", f"SELECT doc_id, array_to_string({_secret('text')}, ',') AS names FROM documents")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(privacy.secret_names(F.col("text")), ",").alias("names"))


_REDACTED = "text"
for _n, _p in privacy.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p.replace(chr(39), chr(39) * 2)}', '[REDACTED:{_n}]', 'g')"


@query("redact", f"SELECT doc_id, sha256({_REDACTED}) AS text_hash, ({_REDACTED}) <> text AS changed FROM documents")
def redact(spark: SparkSession, sf: str) -> DataFrame:
    out = privacy.redact(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(out, 256).alias("text_hash"), (out != F.col("text")).alias("changed"))


def _head(n: int) -> str:
    """SQL: the longest head of text that has n bytes at most."""
    return f"left(text, list_max(list_filter(range(0, {n + 1}), lambda i: strlen(left(text, i)) <= {n})))"


@query("preview", f"SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE {_head(300)} || ' …' END AS preview FROM documents")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("encrypt_round_trip", "SELECT item_id, text FROM benchmark")
def encrypt_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lit(privacy.derive_key("a password", b"sixteen byte salt"[:16]))
    return table(spark, sf, "benchmark").select("item_id", privacy.decrypt(privacy.encrypt(F.col("text"), key), key).cast("string").alias("text"))


@query("html_text")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", extract.html_udf("html").alias("text"))


# ---------------------------------------------------------------- answers

_ANS = "answers AS (SELECT item_id, 'see [' || (item_id % 5 + 1) || '], [' || (item_id % 7) || '] and [2][99999999999] of ' || text AS answer, ['a.md', 'b.md', '', 'a.md'] AS paths FROM benchmark)"
_CIT = "cited AS (SELECT *, CASE WHEN len(v) > 0 THEN v ELSE [1, 2, 3, 4] END AS c FROM (SELECT *, list_filter(list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 1 AND 4) AS v0, list_filter(v0, lambda x, i: list_position(v0, x) = i) AS v FROM answers))"
_SRC = "listed AS (SELECT *, list_filter(p0, lambda x, i: x <> '' AND list_position(p0, x) = i) AS src FROM (SELECT *, list_transform(c, lambda x: paths[x]) AS p0 FROM cited))"


def answered(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    answer = F.concat(F.lit("see ["), (i % 5 + 1).cast("string"), F.lit("], ["), (i % 7).cast("string"), F.lit("] and [2][99999999999] of "), F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", answer.alias("answer"), F.array(*map(F.lit, ("a.md", "b.md", "", "a.md"))).alias("paths")).withColumn("c", answers.citations(F.col("answer"), F.size("paths")))


@query("citations", f"WITH {_ANS}, {_CIT} SELECT item_id, array_to_string(c, ',') AS cited FROM cited")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return answered(spark, sf).select("item_id", F.array_join(F.col("c").cast("array<string>"), ",").alias("cited"))


@query("source_list", f"WITH {_ANS}, {_CIT}, {_SRC} SELECT item_id, CASE WHEN len(src) = 0 THEN '' ELSE chr(10) || 'Sources:' || chr(10) || array_to_string(list_transform(src, lambda x, i: i || '. ' || x || chr(10)), '') END AS listed FROM listed")
def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return answered(spark, sf).select("item_id", answers.source_list(answers.sources(F.col("paths"), F.col("c"))).alias("listed"))


_PRE, _POST = (answers.RULES + answers.BEGIN + "\n\n").replace("'", "''"), (answers.END + "\n\nUSER QUESTION:\n").replace("'", "''")


@query("prompt_build", f"SELECT item_id, sha256('{_PRE}' || '[1] Source: a.md' || chr(10) || text || chr(10) || chr(10) || '[2] Source: b.md' || chr(10) || lower(text) || chr(10) || chr(10) || '{_POST}' || 'what is ' || item_id || '\n\nANSWER (cite sources by [number]; based only on the context above):\n') AS prompt_hash FROM benchmark")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array(F.struct(F.lit("a.md").alias("path"), F.col("text").alias("text")), F.struct(F.lit("b.md").alias("path"), F.lower("text").alias("text")))
    return table(spark, sf, "benchmark").select("item_id", F.sha2(answers.prompt(F.concat(F.lit("what is "), F.col("item_id").cast("string")), parts), 256).alias("prompt_hash"))


# ---------------------------------------------------------------- mail and commands

_ANY = lambda t, ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"
_SUBJECTS = ["Interview on Monday", "Big sale, 50% off", "Sale deadline", "Hello", "Your receipt", "Flight 12:30", "lunch 3/4", "residue notes"]
_MAIL = f"m AS (SELECT conv_id, turn, list_element([{names(_SUBJECTS)}], ((conv_id + turn) % {len(_SUBJECTS)} + 1)::INTEGER) AS subject, role AS snippet, text AS body FROM conversations), t AS (SELECT *, lower(subject || ' ' || snippet || ' ' || left(body, 600)) AS x FROM m)"
_WORTHY = f"(NOT ({_ANY('x', assistant.JUNK_WORDS)} AND NOT {_ANY('x', assistant.STRONG_WORDS)}) AND ({_ANY('x', assistant.EVENT_WORDS)} OR regexp_matches(x, '{assistant.DATES}') OR regexp_matches(x, '{assistant.TIMES}')))"


def mails(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    subject = F.element_at(F.array(*map(F.lit, _SUBJECTS)), ((F.col("conv_id") + F.col("turn")) % len(_SUBJECTS) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), subject.alias("subject"), F.col("role").alias("snippet"), F.col("text").alias("body"))


@query("mail_prefilter", f"WITH {_MAIL} SELECT conv_id, turn, {_WORTHY} AS worthy FROM t")
def mail_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return mails(spark, sf).select("conv_id", "turn", assistant.worthy(assistant.mail_text(F.col("subject"), F.col("snippet"), F.col("body"))).alias("worthy"))


_COMMANDS = ["Open the downloads folder.", "open code", "please send an email to Alex saying I'm late", "Draft a mail to Kim about lunch", "check my inbox", "what is on today?", "good morning!", "turn it up", "quieter", "next track", "go back", "pause", "play a song", "", "open nothing", "reopen editor"]


#: What each command means: name, argument, recipient, message.
_INTENTS = [
    ("open_folder", "downloads", None, None), ("open_app", "code", None, None), ("send_email", None, "Alex", "I'm late"), ("draft_email", None, "Kim", "lunch"), ("scan_mail", None, None, None), ("today", None, None, None),
    ("brief", None, None, None), ("music_volume_up", None, None, None), ("music_volume_down", None, None, None), ("music_next", None, None, None), ("music_previous", None, None, None), ("music_play_pause", None, None, None),
    ("unknown", None, None, None), ("unknown", None, None, None), ("unknown", None, None, None), ("unknown", None, None, None),
]
_SAID = ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in (c, *meant))]) + ")" for i, (c, meant) in enumerate(zip(_COMMANDS, _INTENTS)))


@query("intent_route", f"""WITH k(i, command, name, arg, recipient, message) AS (VALUES {_SAID})
SELECT conv_id, turn, command, name, arg, recipient, message FROM (SELECT conv_id, turn, (conv_id * 3 + turn) % {len(_COMMANDS)} AS i FROM conversations) JOIN k USING (i)""")
def intent_route(spark: SparkSession, sf: str) -> DataFrame:
    """Commands by turn."""
    c = table(spark, sf, "conversations")
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), ((F.col("conv_id") * 3 + F.col("turn")) % len(_COMMANDS) + 1).cast("int"))
    return c.select("conv_id", "turn", command.alias("command")).select("conv_id", "turn", "command", assistant.intent(F.col("command")).alias("i")).select("conv_id", "turn", "command", "i.name", "i.arg", "i.recipient", "i.message")


_CAND = """c AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type || ' ' || user_id END AS title, CASE event_type WHEN 'signup' THEN 'meeting' WHEN 'purchase' THEN 'payment' WHEN 'view' THEN 'interview' WHEN 'click' THEN 'other' ELSE 'exam' END AS category,
CASE WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%H:%M') END AS start_time, CASE WHEN event_id % 6 = 0 THEN '23:59' END AS end_time, false AS all_day, (event_id % 50) / 50.0 + 0.02 AS confidence FROM events)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "meeting").when(F.col("event_type") == "purchase", "payment").when(F.col("event_type") == "view", "interview").when(F.col("event_type") == "click", "other").otherwise("exam")
    return e.select(
        "event_id", F.when(i % 11 == 0, " ").otherwise(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))).alias("title"), kind.alias("category"),
        F.when(i % 9 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.when(i % 4 != 0, F.date_format("ts", "HH:mm")).alias("start_time"), F.when(i % 6 == 0, "23:59").alias("end_time"),
        F.lit(False).alias("all_day"), (i % 50 / F.lit(50.0) + 0.02).alias("confidence"),
    )


_REASON = "CASE WHEN trim(title) = '' THEN 'no title' WHEN date IS NULL THEN 'no date' WHEN confidence < 0.7 THEN format('low confidence ({:.2f} < 0.7)', confidence) WHEN category = 'other' AND confidence < 0.8 THEN 'vague / unclear commitment' END"


@query("candidate_validate", f"WITH {_CAND} SELECT event_id, {_REASON} AS reject_reason FROM c")
def candidate_validate(spark: SparkSession, sf: str) -> DataFrame:
    return events.validated(candidates(spark, sf)).select("event_id", "reject_reason")


_HOUR = "strftime(strptime(start_time, '%H:%M') + INTERVAL 1 HOUR, '%H:%M')"
_DEF = f"d AS (SELECT *, CASE WHEN start_time IS NULL THEN true ELSE all_day END AS whole, CASE WHEN start_time IS NULL THEN NULL WHEN end_time IS NULL AND category IN ('meeting', 'interview', 'appointment') THEN {_HOUR} ELSE end_time END AS stop FROM c WHERE {_REASON} IS NULL)"


@query("candidate_defaults", f"WITH {_CAND}, {_DEF} SELECT event_id, whole AS all_day, start_time, stop AS end_time FROM d")
def candidate_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return events.validated(candidates(spark, sf)).where("reject_reason is null").select("event_id", "all_day", "start_time", "end_time")


@query("calendar_rows", f"""WITH {_CAND}, {_DEF} SELECT event_id, title AS summary, CASE WHEN NOT whole THEN date || 'T' || start_time || ':00' ELSE date END AS start,
CASE WHEN NOT whole THEN date || 'T' || coalesce(stop, start_time) || ':00' ELSE strftime(date::DATE + 1, '%Y-%m-%d') END AS "end" FROM d""")
def calendar_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    ok = events.validated(candidates(spark, sf)).where("reject_reason is null")
    return ok.select("event_id", assistant.calendar_row(c("title"), c("date"), c("start_time"), c("end_time"), c("all_day")).alias("e")).select("event_id", "e.summary", "e.start", "e.end")


@query("event_overlap", f"""WITH {_CAND} SELECT event_id, coalesce(start_time, '') = '' OR (event_id % 5 = 0) OR (start_time < (CASE WHEN event_id % 3 = 0 THEN '15:00' ELSE '16:00' END) AND '15:00' < coalesce(end_time, start_time)) AS overlaps FROM c""")
def event_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Against an event at 15:00, to 16:00 or without an end, or an all-day one."""
    i = F.col("event_id")
    start = F.when(i % 5 == 0, "2024-01-01").otherwise("2024-01-01T15:00:00Z")
    end = F.when((i % 5 == 0) | (i % 3 == 0), "").otherwise("2024-01-01T16:00:00Z")
    return candidates(spark, sf).select("event_id", assistant.overlap(F.col("start_time"), F.col("end_time"), start, end).alias("overlaps"))


@query("mail_source", "SELECT conv_id, turn, role AS sender, left(text, 3000) AS body FROM conversations")
def mail_source(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as raw messages, and back."""
    c = table(spark, sf, "conversations")
    data = F.translate(F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")), "+/", "-_")
    raw = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.struct(F.array(F.struct(F.lit("From").alias("name"), F.col("role").alias("value"))).alias("headers"), F.struct(data.alias("data")).alias("body")).alias("payload")))
    ids = F.split("id", "-")
    return mail.messages(c.select(raw.alias("value"))).select(F.get(ids, F.lit(0)).cast("long").alias("conv_id"), F.get(ids, F.lit(1)).cast("long").alias("turn"), F.col("from").alias("sender"), "body")


@query("spoken_candidate", f"WITH {_CAND} SELECT event_id, title || CASE WHEN date IS NULL THEN '' ELSE ' on ' || date || CASE WHEN start_time IS NULL THEN '' ELSE ' at ' || start_time END END AS label FROM c")
def spoken_candidate(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    return c.select("event_id", mail.spoken(F.col("title"), F.col("date"), F.col("start_time")).alias("label"))


@query("truncate", "SELECT doc_id, sha256(CASE WHEN strlen(text) <= 200 THEN text ELSE left(text, 200) END) AS head FROM documents WHERE regexp_full_match(left(text, 200), '[\\x00-\\x7F]*')")
def truncate(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 bytes, of texts that begin with so many ASCII characters (so that SQL can say it)."""
    docs = table(spark, sf, "documents").where(F.left("text", F.lit(200)).rlike("^[\\x00-\\x7F]*$"))
    return docs.select("doc_id", F.sha2(text.truncated(F.col("text"), 200), 256).alias("head"))


@query("truncate_all", f"SELECT doc_id, sha256({_head(200)}) AS head FROM documents")
def truncate_all(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 bytes of every text, cut at whole characters."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.truncated(F.col("text"), 200), 256).alias("head"))


@query("event_dedupe")
def event_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates against all dated events but the one that a candidate is made of."""
    c = candidates(spark, sf)
    mine = c.withColumn("candidate_id", F.col("event_id"))
    theirs = c.where("date is not null").select(F.col("event_id").alias("id"), F.col("title").alias("summary"), F.concat("date", F.lit("T"), F.coalesce("start_time", F.lit("09:00")), F.lit(":00Z")).alias("start"), F.lit("").alias("end"))
    return events.duplicates(mine, theirs).where("candidate_id <> event_id")


@query("json_candidates", "SELECT conv_id, turn, count(*) AS n FROM (SELECT conv_id, turn, unnest(range(CASE (conv_id + turn) % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)) AS k FROM conversations) GROUP BY ALL")
def json_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Replies as a list of two, an object with one, an object without, and broken text."""
    m = mails(spark, sf)
    k = (F.col("conv_id") + F.col("turn")) % 4
    raw = F.when(k == 0, '[{"title": "a", "confidence": 0.9}, {"title": "b", "category": " EXAM "}]').when(k == 1, '{"candidates": [{"title": "c"}]}').when(k == 2, '{"other": 1}').otherwise("no json")
    got = events.parse(m.select(F.col("id").alias("email_id"), "subject", raw.alias("raw_json")))
    ids = F.split("source_email_id", "-")
    return got.groupBy(F.get(ids, F.lit(0)).cast("long").alias("conv_id"), F.get(ids, F.lit(1)).cast("long").alias("turn")).agg(F.count("*").alias("n"))


_REPLIES = [
    '[{"title": "a", "confidence": "0.9", "date": "2024-01-01"}, {"title": null}, 7, {"title": "b", "confidence": "high"}]',
    '{"candidates": [{"title": "c", "category": " Exam ", "all_day": "yes", "missing_fields": ["end", "place"]}, {"all_day": "perhaps"}]}',
    '[{"confidence": true, "start_time": "10:00"}, {"date": 20240101}, {"missing_fields": [1]}]', '{"candidates": {"title": "x"}}', '{"title": "x"}', "[]", "no json", '[[{"title": "x"}]]',
]
_PARSED = "(0, 'a', 'other', '2024-01-01', NULL, false, 0.9, 0), (1, 'c', 'exam', NULL, NULL, true, 0.0, 2), (2, '', 'other', NULL, '10:00', false, 1.0, 0)"


@query("json_fields", f"""WITH k(i, title, category, date, start_time, all_day, confidence, n_missing) AS (VALUES {_PARSED})
SELECT conv_id, turn, title, category, date, start_time, all_day, confidence::DOUBLE AS confidence, n_missing::INTEGER AS n_missing FROM (SELECT conv_id, turn, (conv_id + turn) % {len(_REPLIES)} AS i FROM conversations) JOIN k USING (i)""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields as numbers, strings and of wrong types; items and replies that are none."""
    m = mails(spark, sf)
    raw = F.element_at(F.array(*map(F.lit, _REPLIES)), ((F.col("conv_id") + F.col("turn")) % len(_REPLIES) + 1).cast("int"))
    got = events.parse(m.select(F.col("id").alias("email_id"), "subject", raw.alias("raw_json")))
    ids = F.split("source_email_id", "-")
    return got.select(F.get(ids, F.lit(0)).cast("long").alias("conv_id"), F.get(ids, F.lit(1)).cast("long").alias("turn"), "title", "category", "date", "start_time", "all_day", "confidence", F.size("missing_fields").alias("n_missing"))


_RECEIVED = "make_timestamp((1704067200000 + conv_id * 3600000 + turn * 60000) * 1000)"
_BOX = f"m AS (SELECT conv_id || '-' || turn AS id, list_element([{names(_SUBJECTS)}], ((conv_id + turn) % {len(_SUBJECTS)} + 1)::INTEGER) AS subject, role AS snippet, left(text, 3000) AS body, {_RECEIVED} AS received FROM conversations), n AS (SELECT *, lower(subject || ' ' || snippet || ' ' || left(body, 600)) AS x FROM m)"
_MAIL_NOW = "2024-01-05T12:00:00"


def mailbox(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as raw messages of a mail service, one an hour and their turns a minute apart."""
    data = F.translate(F.replace(F.base64(F.encode("body", "UTF-8")), F.lit("\r\n"), F.lit("")), "+/", "-_")
    at = (F.lit(1704067200000) + F.col("conv_id") * 3600000 + F.col("turn") * 60000).cast("string")
    head = F.struct(F.lit("Subject").alias("name"), F.col("subject").alias("value"))
    raw = F.to_json(F.struct("id", "snippet", at.alias("internalDate"), F.struct(F.array(head).alias("headers"), F.struct(data.alias("data")).alias("body")).alias("payload")))
    return mail.messages(mails(spark, sf).select(raw.alias("value")))


@query("mail_recent", f"WITH {_BOX} SELECT id, subject, strftime(received, '%Y-%m-%d %H:%M:%S') AS received FROM n WHERE received > TIMESTAMP '{_MAIL_NOW}' - INTERVAL 2 DAY AND received <= TIMESTAMP '{_MAIL_NOW}' ORDER BY received DESC, id LIMIT 40")
def mail_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The newest forty mails of two days."""
    near = events.recent(mailbox(spark, sf), _MAIL_NOW, 2, 40)
    return near.select("id", "subject", F.date_format("received", "yyyy-MM-dd HH:mm:ss").alias("received"))


@query("mail_important", f"""WITH {_BOX}, r AS (SELECT *, {_WORTHY} AS w FROM n WHERE received > TIMESTAMP '{_MAIL_NOW}' - INTERVAL 7 DAY AND received <= TIMESTAMP '{_MAIL_NOW}' ORDER BY received DESC, id LIMIT 5)
SELECT * FROM (SELECT row_number() OVER (ORDER BY received DESC, id)::INTEGER AS rank, id, subject FROM r WHERE w OR NOT (SELECT bool_or(w) FROM r)) WHERE rank <= 3""")
def mail_important(spark: SparkSession, sf: str) -> DataFrame:
    return events.important(mailbox(spark, sf), _MAIL_NOW)


@query("candidate_listing", f"""WITH {_CAND} SELECT event_id, event_id || '. ' || title || format('  ({{}}, confidence {{:.2f}})', category, confidence) || chr(10) || '    When: ' || coalesce(date, '?')
|| CASE WHEN start_time IS NOT NULL THEN ' ' || start_time || CASE WHEN end_time IS NOT NULL THEN '-' || end_time ELSE '' END ELSE '' END
|| CASE WHEN event_id % 3 = 0 THEN chr(10) || '    Where: room ' || event_id % 7 ELSE '' END || chr(10) || '    Why: ' || chr(10) || '    From: s' || CASE WHEN event_id % 4 = 0 THEN chr(10) || '    Missing: start_time, place' ELSE '' END AS text FROM c""")
def candidate_listing(spark: SparkSession, sf: str) -> DataFrame:
    c, i, none = candidates(spark, sf), F.col("event_id"), F.array().cast("array<string>")
    full = c.withColumns({
        "no": i, "location": F.when(i % 3 == 0, F.concat(F.lit("room "), (i % 7).cast("string"))), "meeting_link": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "source_subject": F.lit("s"),
        "missing_fields": F.when(i % 4 == 0, F.array(F.lit("start_time"), F.lit("place"))).otherwise(none), "duplicates": none,
    })
    return full.select("event_id", events.listing(full).alias("text"))


@query("cache_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("cache_lookup", "SELECT conv_id, turn, (conv_id + turn) % 3 = 0 AS hit FROM conversations")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    m = mails(spark, sf)
    k = (F.col("conv_id") + F.col("turn")) % 3
    cache = m.where(k < 2).select(F.col("id").alias("message_id"), events.content_hash().alias("snippet_hash"), F.when(k == 0, "[]").otherwise("{}").alias("extracted_json"))
    got = events.with_cache(m.select("id", "subject", "snippet", "body"), cache)
    ids = F.split("email_id", "-")
    return got.select(F.get(ids, F.lit(0)).cast("long").alias("conv_id"), F.get(ids, F.lit(1)).cast("long").alias("turn"), "hit")


_NOW = "2024-01-05T00:00:00"


@query("agenda_fast", f"""WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS start, event_type AS summary FROM events),
a AS (SELECT * FROM e WHERE start >= '{_NOW}' AND start <= '2024-01-07T00:00:00' ORDER BY start, id LIMIT 20), b AS (SELECT * FROM e WHERE start >= '{_NOW}' AND start <= '2024-01-19T00:00:00' ORDER BY start, id LIMIT 50)
SELECT 'calendar' AS section, row_number() OVER (ORDER BY start, id)::INTEGER AS rank, start, summary FROM a WHERE contains(start, 'T')
UNION ALL SELECT * FROM (SELECT 'deadline' AS section, row_number() OVER (ORDER BY start, id)::INTEGER AS rank, start, summary FROM b WHERE NOT contains(start, 'T')) WHERE rank <= 5""")
def agenda_fast(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return events.agenda(e.select(F.col("event_id").alias("id"), start.alias("start"), F.col("event_type").alias("summary")), _NOW)


# ---------------------------------------------------------------- signals


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a signal: 20 ms apart, by id."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").withColumn("i", F.row_number().over(w) - 1)
    return e.select("user_id", "i", (F.col("i") * 0.02).alias("t"), (F.col("value") % 1).alias("peak"))


_PEAKS = "p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value % 1 AS peak FROM events)"
_AT = "(f.i + 1)::DOUBLE * 0.02::DOUBLE"
_HIT = f"peak >= 0.25::DOUBLE AND armed AND {_AT} - last BETWEEN 0.12::DOUBLE AND 0.8::DOUBLE"


@query("burst_detect", f"""WITH RECURSIVE {_PEAKS}, f(user_id, i, armed, last, fired) AS (SELECT DISTINCT user_id, -1::BIGINT, true, NULL::DOUBLE, NULL::DOUBLE FROM p UNION ALL
SELECT f.user_id, f.i + 1, CASE WHEN peak >= 0.25::DOUBLE AND armed THEN false WHEN peak < 0.125::DOUBLE THEN true ELSE armed END,
  CASE WHEN {_HIT} THEN NULL WHEN peak >= 0.25::DOUBLE AND armed THEN {_AT} WHEN peak < 0.125::DOUBLE AND {_AT} - last > 0.8::DOUBLE THEN NULL ELSE last END, CASE WHEN {_HIT} THEN {_AT} END
  FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1 WHERE fired IS NULL)
SELECT user_id, max(fired) AS fired_at FROM f GROUP BY user_id""")
def burst_detect(spark: SparkSession, sf: str) -> DataFrame:
    return signals.double_bursts(peaks(spark, sf), "user_id", "i", "t", "peak")


@query("endpointing", f"""WITH RECURSIVE {_PEAKS}, f(user_id, i, start, n, quiet, over) AS (SELECT DISTINCT user_id, -1::BIGINT, -1::BIGINT, 0, 0, false FROM p UNION ALL
SELECT f.user_id, f.i + 1, CASE WHEN f.start >= 0 OR peak < 0.5::DOUBLE THEN f.start ELSE f.i + 1 END, n + (peak >= 0.5::DOUBLE OR f.start >= 0)::INTEGER, CASE WHEN peak >= 0.5::DOUBLE THEN 0 ELSE quiet + 1 END,
  peak < 0.5::DOUBLE AND CASE WHEN f.start >= 0 THEN quiet + 1 >= 3 ELSE f.i + 1 >= 50 END FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1 WHERE NOT over AND f.i + 1 < 50)
SELECT user_id, arg_max(start, i)::INTEGER AS begin, max(n)::INTEGER AS length FROM f GROUP BY user_id""")
def endpointing(spark: SparkSession, sf: str) -> DataFrame:
    return signals.endpoints(peaks(spark, sf), "user_id", "i", "peak", threshold=0.5, trailing=3)


@query("signal_levels", "SELECT user_id, round(max(abs(value)), 6) AS peak, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY user_id")
def signal_levels(spark: SparkSession, sf: str) -> DataFrame:
    return signals.levels(table(spark, sf, "events"), "user_id", "value").select("user_id", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))
