"""Registered queries of the engine's operators, each with the SQL that gives the
same rows.  Queries run over their whole tables; limits are those of top-k
operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import temporal, text, timeexpr, vectors
from ..operators import conflict, evaluation, extraction, graph, jobs, models, rerank, retrieval
from ..sources import profiles
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
T = A.table


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


QUERY = "What things would the station that heading and the tion of reading be like?"
WORDS = text.query_stems("stations heading there of reading and tion thes er that ing")
EXPANSION = ["ation", "ther", "inger"]
ANCHOR = dt.datetime(2024, 1, 28, 12)

# ---- text -----------------------------------------------------------------

STEM_SQL = """CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3)
 WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%es' AND length({w}) > 4 THEN left({w}, length({w}) - 2)
 WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"""
STEMMED = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
s1 AS (SELECT doc_id, {STEM_SQL.format(w="w")} AS s FROM w),
st AS (SELECT DISTINCT doc_id, CASE WHEN s LIKE '%e' AND length(s) > 3 THEN left(s, length(s) - 1) ELSE s END AS stem FROM s1)"""
LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


def keyword_pool(spark: SparkSession, d: str, words: list[str]) -> DataFrame:
    """documents as facts with those of the words' stems that they hold."""
    return T(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ins_seq"), text.matched_stems(F.col("text"), words).alias("stems"))


def fact_pool(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ins_seq"), text.stems_of(F.col("text")).alias("stems"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n_terms, md5(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ')) AS digest FROM documents")
def tokenize_terms(spark, d):
    words = text.words_of(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_terms"), F.md5(F.array_join(words, " ")).alias("digest"))


@query(f"WITH {STEMMED} SELECT doc_id, count(*) AS n_stems FROM st GROUP BY doc_id")
def stem_terms(spark, d):
    return fact_pool(spark, d).where(F.size("stems") > 0).select(F.col("id").alias("doc_id"), F.size("stems").cast("long").alias("n_stems"))


@query(f"WITH {STEMMED} SELECT stem, count(*) AS df FROM st GROUP BY stem")
def doc_freq(spark, d):
    return retrieval.document_frequency(fact_pool(spark, d))


@query(f"WITH {STEMMED}, n AS (SELECT count(*) AS n FROM documents) SELECT stem, round(ln((n + 1.0) / (count(*) + 1.0)) + 1, 6) AS idf FROM st, n GROUP BY stem, n")
def idf_weights(spark, d):
    pool = fact_pool(spark, d)
    return retrieval.document_frequency(pool).crossJoin(F.broadcast(pool.agg(F.count("*").alias("n")))).select("stem", F.round(retrieval.idf(F.col("df"), F.col("n")), 6).alias("idf"))


KEYED = f"""WITH {STEMMED}, n AS (SELECT greatest(count(*), 1) AS n FROM documents), q AS (SELECT unnest({LIST}) AS stem),
dfs AS (SELECT q.stem, ln((n + 1.0) / ((SELECT count(*) FROM st WHERE st.stem = q.stem) + 1.0)) + 1 AS idf FROM q, n),
tot AS (SELECT sum(idf) AS t FROM dfs),
m AS (SELECT d.doc_id AS id, coalesce(sum(idf), 0.0) AS mass, count(dfs.stem) AS k FROM documents d LEFT JOIN st USING (doc_id) LEFT JOIN dfs ON dfs.stem = st.stem GROUP BY d.doc_id)"""


@query(f"{KEYED} SELECT id, round(mass / t, 6) AS overlap, round(k / {float(len(WORDS))}, 6) AS coverage, round(mass, 6) AS mass FROM m, tot")
def coverage_mass(spark, d):
    scored = retrieval.keyword_scores(keyword_pool(spark, d, WORDS), WORDS)
    return scored.select("id", *[F.round(c, 6).alias(c) for c in ("overlap", "coverage", "mass")])


@query(f"""{KEYED} SELECT id, round(2 * mass / t, 6) AS score, row_number() OVER (ORDER BY floor(round(2 * mass / t, 9) / 0.25 + 0.5) DESC, k DESC, round(mass, 9) DESC, id) AS place FROM m, tot QUALIFY place <= 20""")
def keyword_topk(spark, d):
    scored = retrieval.keyword_scores(keyword_pool(spark, d, WORDS), WORDS).withColumns({"score": F.round(retrieval.OVERLAP * F.col("overlap"), 9), "mass": F.round("mass", 9)})
    top = scored.orderBy(F.desc(retrieval.bucket(F.col("score"))), F.desc("coverage"), F.desc("mass"), "ins_seq").limit(20)
    place = F.row_number().over(Window.orderBy(F.desc(retrieval.bucket(F.col("score"))), F.desc("coverage"), F.desc("mass"), "ins_seq"))
    return top.select("id", F.round("score", 6).alias("score"), place.cast("long").alias("place"))


# digits as CJK signs, so that numbers of several lengths become runs
CJK_NAME = "translate(c_name || ' ' || c_mktsegment || c_custkey, '0123456789#', '零一二三四五六七八九 ')"


@query(f"""WITH n AS (SELECT c_custkey, lower({CJK_NAME}) AS t FROM customer),
g AS (SELECT c_custkey, t, list_transform(regexp_extract_all(t, '[一-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_concat([r], list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) END) AS runs FROM n)
SELECT c_custkey, array_to_string(list_concat(regexp_extract_all(t, '[a-z]+'), flatten(runs)), ' ') AS terms FROM g""")
def token_bigrams_cjk(spark, d):
    name = F.translate(F.concat("c_name", F.lit(" "), "c_mktsegment", F.col("c_custkey").cast("string")), "0123456789#", "零一二三四五六七八九 ")
    return T(spark, d, "customer").select("c_custkey", F.array_join(text.words_of(name), " ").alias("terms"))


STOP_SQL = ", ".join(f"'{w}'" for w in [*text.STOPWORDS, *text.LIGHT_WORDS])


@query(rf"""WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'What kind of ' || p_name || 's did the ' || lower(p_type) || ' ones really like?' WHEN p_partkey % 3 = 1 THEN 'list all the things and ' || p_name || ' going there' ELSE 'Where is ' || p_name || '?' END AS q FROM part),
b AS (SELECT q, regexp_replace(regexp_replace(lower(q), '^(what|when|where|who|why|how|which|would|did|does|is|are|has|have|do)\s+', ''), '\b(kind|type|sort) of\b', ' ', 'g') AS t FROM q),
w AS (SELECT q, unnest(regexp_extract_all(t, '[a-z]+')) AS w FROM b), k AS (SELECT q, {STEM_SQL.format(w='w')} AS s FROM w WHERE length(w) > 3 AND w NOT IN ({STOP_SQL})),
e AS (SELECT q, CASE WHEN s LIKE '%e' AND length(s) > 3 THEN left(s, length(s) - 1) ELSE s END AS s FROM k)
SELECT b.q AS question, coalesce(string_agg(DISTINCT s, ' ' ORDER BY s), '') AS terms, regexp_matches(lower(b.q), '^(what|which|list|name)\b') AND regexp_matches(lower(b.q), 'all the|kinds of|types of|things|items|do to|like to') AS is_list FROM b LEFT JOIN e USING (q) GROUP BY b.q""")
def key_descriptors(spark, d):
    """Questions are read on the driver, one at a time, as each is one user's."""
    k = F.col("p_partkey") % 3
    asked = F.when(k == 0, F.concat(F.lit("What kind of "), "p_name", F.lit("s did the "), F.lower("p_type"), F.lit(" ones really like?"))).when(k == 1, F.concat(F.lit("list all the things and "), "p_name", F.lit(" going there"))).otherwise(F.concat(F.lit("Where is "), "p_name", F.lit("?")))
    rows = [(r["q"], " ".join(text.key_descriptors(r["q"])), text.is_list_question(r["q"])) for r in T(spark, d, "part").select(asked.alias("q")).distinct().toLocalIterator()]
    return A.values(spark, rows, "question string, terms string, is_list boolean")


@query(r"SELECT c_custkey, trim(regexp_replace(lower(c_name || '   #' || c_mktsegment), '\s+', ' ', 'g')) AS name FROM customer")
def norm_names(spark, d):
    return T(spark, d, "customer").select("c_custkey", text.norm_name(F.concat("c_name", F.lit("   #"), "c_mktsegment")).alias("name"))


@query("SELECT doc_id, length(text) > 20000 AS cut, CASE WHEN length(text) > 20000 THEN 12000 + 7 + (20000 - 12000 - 7) ELSE length(text) END AS n, md5(CASE WHEN length(text) > 20000 THEN left(text, 12000) || chr(10) || '[...]' || chr(10) || right(text, 20000 - 12000 - 7) ELSE text END) AS digest FROM documents")
def cap_text(spark, d):
    c = text.cap_text(F.col("text"))
    return T(spark, d, "documents").select("doc_id", (F.length("text") > text.CAP).alias("cut"), F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query(r"""WITH s AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'Now: what of ' || role || ': is it so? ' || chr(10) || 'end' WHEN 2 THEN '问题：' || role || '在哪里？' || chr(10) || text ELSE left(text, 40) || '?' END AS s FROM conversations),
l AS (SELECT *, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '[?？]')) AS q FROM s), t AS (SELECT *, q[-1] AS line FROM l)
SELECT conv_id, turn, md5(CASE WHEN length(s) <= 300 THEN s ELSE coalesce(CASE WHEN regexp_matches(regexp_extract(line, '^.*(?:: |：)(.*)$', 1), '[?？]') THEN regexp_extract(line, '^.*(?:: |：)(.*)$', 1) ELSE line END, s) END) AS line FROM t""")
def distill_line(spark, d):
    k, role = F.col("turn") % 4, F.col("role")
    asked = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("\nNow: what of "), role, F.lit(": is it so? \nend"))).when(k == 2, F.concat(F.lit("问题："), role, F.lit("在哪里？\n"), "text")).otherwise(F.concat(F.left("text", F.lit(40)), F.lit("?")))
    return T(spark, d, "conversations").select("conv_id", "turn", F.md5(text.distill(asked)).alias("line"))


def _secret_sql(column: str) -> str:
    out = column
    for pattern, put in text.SECRETS:
        flags, bare = ("gi", pattern[4:]) if pattern.startswith("(?i)") else ("g", pattern)
        out = f"regexp_replace({out}, '{bare.replace(chr(39), chr(39) * 2)}', '{put.replace('$', chr(92))}', '{flags}')"
    return out


@query(f"SELECT doc_id, md5({_secret_sql('text')}) AS clean, {_secret_sql('text')} <> text AS had FROM documents")
def secret_scrub(spark, d):
    clean = text.scrub_secrets(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.md5(clean).alias("clean"), (clean != F.col("text")).alias("had"))


FIELD_OF = "CASE o_orderkey % 5 WHEN 0 THEN ' PREDICATE ' WHEN 1 THEN '_' WHEN 2 THEN ' ' || o_orderpriority || ' ' WHEN 3 THEN 'UNKNOWN' ELSE lower('UNKNOWN') END"
PLACEHOLDER_SQL = ", ".join(f"'{w}'" for w in text.PLACEHOLDERS)


@query(f"SELECT o_orderkey, CASE WHEN trim({FIELD_OF}) IN ({PLACEHOLDER_SQL}) THEN '' ELSE trim({FIELD_OF}) END AS field FROM orders")
def field_clean(spark, d):
    return T(spark, d, "orders").select("o_orderkey", text.clean_field(F.expr(FIELD_OF)).alias("field"))


@query("SELECT event_id, '- [' || coalesce(CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END, strftime(ts, '%Y-%m-%d')) || '] ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' (d' || event_id || ')' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ' [superseded — newer value exists]' ELSE '' END AS line FROM events")
def format_line(spark, d):
    i = F.col("event_id")
    line = text.memory_line(F.lit(""), F.when(i % 3 != 0, F.col("ts")), F.col("ts"), F.col("event_type"), F.when(i % 2 == 0, F.concat(F.lit("d"), i)).otherwise(""), F.when(i % 5 == 0, i))
    return T(spark, d, "events").select("event_id", line.alias("line"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return T(spark, d, "events").select("event_id", F.from_json("props", "k LONG")["k"].alias("k"))


def _kind_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{k}'" for k, p in text.LITERAL_KINDS) + " END"


SPELLED = "CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'v' || event_id || '.2.3' WHEN 2 THEN event_id || 'ms' WHEN 3 THEN 'None' WHEN 4 THEN event_type || 'Name' || event_id WHEN 5 THEN upper(event_type) || '_SIZE' WHEN 6 THEN event_type || event_id || '.md' ELSE CASE WHEN event_id % 3 = 0 THEN '~/' || event_type ELSE initcap_first || ' thing' END END"


@query(f"WITH e AS (SELECT event_id, event_type, upper(left(event_type, 1)) || substring(event_type, 2) AS initcap_first FROM events), n AS (SELECT event_id, {SPELLED} AS s FROM e) SELECT event_id, {_kind_sql('s')} AS kind FROM n")
def literal_kinds(spark, d):
    e = T(spark, d, "events").select(F.col("event_id").cast("long"), "event_type", F.initcap("event_type").alias("initcap_first"))
    return e.select("event_id", text.literal_kind(F.expr(SPELLED.replace("VARCHAR", "STRING"))).alias("kind"))


PREDICATE_OF = "CASE p_partkey % 4 WHEN 0 THEN 'was_' || replace(p_name, ' ', '_') || 's' WHEN 1 THEN 'does_not_' || lower(p_type) WHEN 2 THEN '不' || lower(p_brand) || '_is_of' ELSE 'has ' || p_name || 's and glass' END"


@query(f"""WITH p AS (SELECT p_partkey, {PREDICATE_OF} AS s FROM part), t AS (SELECT p_partkey, list_filter(string_split_regex(lower(regexp_replace(s, '[{text.CJK_NEGATION}]', '', 'g')), '[^a-z0-9一-鿿]+'), lambda x: x <> '' AND NOT list_contains([{", ".join(f"'{w}'" for w in [*text.NEGATIONS, *text.LIGHT_VERBS])}], x)) AS t FROM p)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(t, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END))), ' ') AS tokens FROM t""")
def predicate_tokens_overlap(spark, d):
    return T(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.predicate_tokens(F.expr(PREDICATE_OF))), " ").alias("tokens"))


# ---- vectors --------------------------------------------------------------

VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
VSQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
VCOL = lambda: F.array(*[F.lit(x) for x in VECTOR])


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VSQL}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def dense_topk(spark, d):
    score = F.round(vectors.cosine(F.col("embedding").cast("array<double>"), VCOL()), 6)
    return T(spark, d, "embeddings").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {VSQL}), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {VSQL}) >= 0.1")
def dense_threshold(spark, d):
    score = vectors.cosine(F.col("embedding").cast("array<double>"), VCOL())
    return T(spark, d, "embeddings").withColumn("s", score).where("s >= 0.1").select("vec_id", "label", F.round("s", 6).alias("score"))


@query("""WITH c AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT c.vec_id, e.vec_id AS near, round(list_cosine_similarity(c.v, e.embedding::DOUBLE[]), 6) AS s FROM c, embeddings e WHERE e.vec_id <> c.vec_id)
SELECT vec_id, arg_max(near, (s, -near)) AS near, max(s) AS score FROM p GROUP BY vec_id""")
def nearest_entity(spark, d):
    """Queries: rows with an id divisible by 20, in blocks, against all rows."""
    e = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = vectors.nearest(e.where("id % 20 = 0"), e)
    return near.select(F.col("query_id").alias("vec_id"), F.col("near_id").alias("near"), "score")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def vector_norm(spark, d):
    v = F.col("embedding").cast("array<double>")
    return T(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("norm"), F.round(vectors.l2_normalize(v)[0], 5).alias("first"))


@query("WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS dim FROM embeddings) SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(x), 5) AS mean FROM u GROUP BY ALL")
def mean_pool_by_label(spark, d):
    u = T(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return u.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(f"""{KEYED}, h AS (SELECT id, 2 * mass / t AS k2, list_cosine_similarity(e.embedding::DOUBLE[], {VSQL}) AS c FROM m CROSS JOIN tot LEFT JOIN embeddings e ON e.vec_id = m.id)
SELECT id, round(coalesce(c, 0.0) + k2, 6) AS score FROM h ORDER BY round(coalesce(c, 0.0) + k2, 6) DESC, id LIMIT 25""")
def hybrid_score_topk(spark, d):
    keyed = retrieval.keyword_scores(keyword_pool(spark, d, WORDS), WORDS)
    v = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.cosine(F.col("embedding").cast("array<double>"), VCOL()).alias("c"))
    score = F.round(F.coalesce("c", F.lit(0.0)) + retrieval.OVERLAP * F.col("overlap"), 6)
    return keyed.join(v, "id", "left").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(25)


# ---- journal and graph ----------------------------------------------------


@query(f"""WITH {A.JOURNAL_SQL}, x AS (SELECT *, max(seq) OVER w AS last, max(CASE WHEN op = 'event.delete' THEN seq END) OVER w AS dead FROM j WINDOW w AS (PARTITION BY rid)),
f AS (SELECT rid, min(seq) AS ins_seq FROM x WHERE dead IS NULL OR seq > dead GROUP BY rid)
SELECT x.rid, payload, f.ins_seq FROM x JOIN f USING (rid) WHERE seq = last AND op = 'event.add'""")
def journal_replay_live(spark, d):
    return graph.replay(A.journal(spark, d), "event", F.col("rid")).select("rid", "payload", "ins_seq")


@query(f"WITH {A.JOURNAL_SQL}, l AS (SELECT rid, arg_max(op, seq) AS op FROM j GROUP BY rid) SELECT (SELECT count(*) FROM j) AS records, (SELECT count(*) FROM l WHERE op = 'event.add') AS live, (SELECT count(*) FROM l WHERE op <> 'event.add') AS gone")
def journal_compact_counts(spark, d):
    last = A.journal(spark, d).groupBy("rid").agg(F.count("*").alias("n"), F.max_by("op", "seq").alias("op"))
    return last.agg(F.sum("n").alias("records"), F.expr("count_if(op = 'event.add')").alias("live"), F.expr("count_if(op <> 'event.add')").alias("gone"))


#: A line a row: records, records of another version or kind or without a field, torn and blank lines.
LINE_OF = """CASE event_id % 9 WHEN 0 THEN '{"v":1,"op":"entity.upsert","data":{"id":"' || event_id || '","canonical_name":"' || event_type || '","type":"PERSON"}}'
 WHEN 1 THEN '{"v":1,"op":"event.add","data":{"id":"' || event_id || '","normaliz' WHEN 2 THEN '{"v":2,"op":"event.add","data":{"id":"' || event_id || '","normalized_text":"t"}}'
 WHEN 3 THEN '{"v":1,"op":"event.add","data":{"id":"' || event_id || '","normalized_text":"' || event_type || '","subject_ids":["a"],"object_ids":[]}}'
 WHEN 4 THEN '{"v":1,"op":"event.add","data":{"id":"' || event_id || '"}}' WHEN 5 THEN '{"v":1,"op":"other","data":{"id":"q"}}' WHEN 6 THEN '  '
 WHEN 7 THEN '{"v":1,"op":"event.delete","data":{"id":"' || event_id || '"}}' ELSE '{"v":1,"op":"event.delete","data":{}}' END"""


@query(f"""WITH l AS (SELECT {LINE_OF} AS l FROM events), f AS (SELECT l, CASE WHEN json_valid(l) THEN CAST(l AS JSON) END AS j FROM l WHERE trim(l) <> ''),
g AS (SELECT coalesce(j->>'$.v' = '1' AND j->>'$.op' IN ('entity.upsert', 'entity.delete', 'event.add', 'event.delete') AND j->>'$.data.id' IS NOT NULL AND (j->>'$.op' <> 'event.add' OR j->>'$.data.normalized_text' IS NOT NULL) AND (j->>'$.op' <> 'entity.upsert' OR j->>'$.data.canonical_name' IS NOT NULL), FALSE) AS ok FROM f)
SELECT count(*) FILTER (NOT ok) AS corrupt, count(*) FILTER (ok) AS valid FROM g""")
def corrupt_lines(spark, d):
    from ..sources.journal import parse_lines

    return graph.corrupt_count(parse_lines(T(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(LINE_OF).alias("value"))))


@query(f"WITH {A.EVENTS_SQL} SELECT subject, predicate, id, mention_time FROM ev QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY mention_time DESC, id DESC) = 1")
def latest_state_per_family(spark, d):
    return retrieval.latest(A.events(spark, d), ["subject", "predicate"], "mention_time", "id")


@query(f"WITH {A.EVENTS_SQL}, s AS (SELECT *, CASE WHEN predicate IN ('purchase', 'signup') THEN 'goal_' || predicate ELSE predicate END AS p FROM ev) SELECT id, p AS predicate FROM s QUALIFY p NOT LIKE 'goal_%' OR row_number() OVER (PARTITION BY subject, regexp_extract(p, '^(goal_)', 1) ORDER BY mention_time DESC, value DESC, id) = 1")
def state_dedup_ranked(spark, d):
    p = F.when(F.col("predicate").isin("purchase", "signup"), F.concat(F.lit("goal_"), F.col("predicate"))).otherwise(F.col("predicate"))
    e = A.events(spark, d).withColumns({"predicate": p, "subject_ids": F.array("subject")})
    return retrieval.dedup_state(e, [F.desc("value"), F.asc("ins_seq")]).select("id", "predicate")


def order_events(spark, d) -> DataFrame:
    """orders with their parts as objects and the customer as subject."""
    l = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: F.concat(F.lit("p"), s["l_partkey"])).alias("object_ids"))
    o = T(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("subject_ids"), F.coalesce("object_ids", F.expr("cast(array() as array<string>)")).alias("object_ids"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderkey").alias("ins_seq"))


@query("""WITH b AS (SELECT 'c' || o_custkey AS entity_id, 'subject' AS role, o_orderkey AS e FROM orders UNION ALL SELECT 'p' || l_partkey, 'object', l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT entity_id, role, count(DISTINCT e) AS n, min(e) AS first FROM b GROUP BY ALL""")
def entity_events_bridge(spark, d):
    held = graph.bridge(order_events(spark, d))
    return held.groupBy("entity_id", "role").agg(F.count_distinct("event_id").alias("n"), F.min("ins_seq").alias("first"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 3 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 3)")
def events_of_entity(spark, d):
    """Events of a customer and of a part."""
    e = order_events(spark, d)
    return graph.events_of(e, "c3").union(graph.events_of(e, "p3")).select("id").distinct()


@query("SELECT o_orderkey AS id, o_orderpriority AS predicate FROM orders WHERE o_orderkey IN (3, 4, 5, 1000000000)")
def point_lookup(spark, d):
    return graph.by_ids(T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("predicate")), [3, 4, 5, 10**9])


DEGREE_SQL = "u AS (SELECT 'c' || o_custkey AS entity_id FROM orders UNION ALL SELECT 'p' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), deg AS (SELECT entity_id, count(*) AS degree FROM u GROUP BY entity_id)"


@query(f"WITH {DEGREE_SQL} SELECT * FROM deg")
def node_degree(spark, d):
    return graph.degrees(order_events(spark, d))


@query("SELECT o_orderkey AS id, 'c' || o_custkey AS source, coalesce('p' || l_partkey, 'c' || o_custkey) AS target, count(*) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def graph_links(spark, d):
    return graph.links(order_events(spark, d)).groupBy("id", "source", "target").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) FROM lineitem) AS entities, (SELECT count(*) FROM lineitem) AS events, (SELECT min(l_shipdate) FROM lineitem) AS first, (SELECT max(l_shipdate) FROM lineitem) AS last")
def graph_stats(spark, d):
    l = T(spark, d, "lineitem")
    return graph.shape(l.select(F.array(F.concat(F.lit("p"), "l_partkey")).alias("subject_ids"), F.array(F.concat(F.lit("s"), "l_suppkey")).alias("object_ids"), F.col("l_shipdate").alias("mention_time")))


@query(f"WITH {DEGREE_SQL}, top AS (SELECT * FROM deg ORDER BY degree DESC, entity_id LIMIT 600) SELECT count(*) AS links, count(DISTINCT o_orderkey) AS events FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE 'c' || o_custkey IN (SELECT entity_id FROM top) AND 'p' || l_partkey IN (SELECT entity_id FROM top)")
def degree_cap(spark, d):
    e = order_events(spark, d).where(F.size("object_ids") > 0)
    _, kept = graph.capped(graph.degrees(order_events(spark, d)), graph.links(e), 600)
    return kept.agg(F.count("*").alias("links"), F.count_distinct("id").alias("events"))


@query("SELECT o_orderkey AS id, CAST(count(l_partkey) FILTER (l_partkey <> 7) AS BIGINT) AS objects FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def cascade_delete(spark, d):
    e = order_events(spark, d)
    entities = e.select(F.explode("object_ids").alias("id")).distinct()
    return graph.delete_entity(entities, e, "p7")[1].select("id", F.size("object_ids").cast("long").alias("objects"))


@query("SELECT event_id FROM events WHERE event_id % 2 = 1")
def idempotent_new_rows(spark, d):
    e = T(spark, d, "events").select("event_id", F.col("user_id").alias("source_session"), F.col("event_id").alias("source_turn"), F.col("event_type").alias("predicate"), F.concat(F.lit("Fact  "), "event_id").alias("normalized_text"), F.lit(" Today").alias("time_expr"))
    old = e.where("event_id % 2 = 0").withColumns({"normalized_text": F.upper("normalized_text"), "time_expr": F.lit("today ")})
    return graph.new_only(e, old).select("event_id")


@query("""WITH f AS (SELECT conv_id * 1000 + turn AS id, lower(text) AS t FROM conversations WHERE turn % 2 = 0),
n(eid, ins, nm) AS (VALUES ('thati', 0, 'thati'), ('the', 1, 'the'), ('oner', 2, 'oner'), ('reing', 3, 'reing'), ('reing', 3, 'ung')),
h AS (SELECT DISTINCT id, eid, ins FROM f, n WHERE contains(t, nm)), l AS (SELECT id, list(eid ORDER BY ins) AS e FROM h GROUP BY id)
SELECT id, e[1] AS subject, array_to_string(e[2:], ',') AS objects FROM l""")
def retro_link(spark, d):
    """Remembered facts without entities, linked to those whose names they hold by now."""
    entities = A.values(spark, [(n, n.title(), "CONCEPT", ["Ung"] if n == "reing" else [], i) for i, n in enumerate(MENTION_NAMES)], "id string, canonical_name string, type string, aliases array<string>, ins_seq long")
    none = F.array().cast("array<string>")
    facts = T(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 2 == 0, "remembered").otherwise("said").alias("predicate"), F.col("text").alias("normalized_text"), none.alias("subject_ids"))
    linked = graph.retro_link(facts, entities)
    return linked.select("id", F.col("subject_ids")[0].alias("subject"), F.array_join("object_ids", ",").alias("objects"))


MENTION_NAMES = ["thati", "the", "oner", "reing"]


@query(f"SELECT conv_id, turn, n.name FROM conversations, (SELECT unnest({MENTION_NAMES}) AS name) n WHERE contains(lower(text), n.name)")
def mention_join(spark, d):
    entities = A.values(spark, [(n, n.title(), [n]) for n in MENTION_NAMES], "id string, canonical_name string, aliases array<string>")
    found = graph.mentions_in(T(spark, d, "conversations").select("conv_id", "turn", "text"), "text", entities)
    return found.select("conv_id", "turn", F.col("entity_id").alias("name"))


@query(f"""WITH {A.BRIDGE_SQL}, hits AS (SELECT l_orderkey * 8 + l_linenumber AS event_id FROM lineitem ORDER BY l_extendedprice DESC, event_id LIMIT 15),
t AS (SELECT DISTINCT entity_id FROM br WHERE event_id IN (SELECT event_id FROM hits)),
r AS (SELECT DISTINCT entity_id, event_id, ins_seq FROM br WHERE entity_id IN (SELECT entity_id FROM t)),
f AS (SELECT event_id FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ins_seq, event_id) <= 200) SELECT DISTINCT event_id FROM f""")
def one_hop_expand(spark, d):
    l = T(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"), "l_extendedprice")
    return retrieval.one_hop(l.orderBy(F.desc("l_extendedprice"), "event_id").limit(15), A.orders_bridge(spark, d))


@query(f"""WITH {A.BRIDGE_SQL}, l AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice / 10000 AS score FROM lineitem), a AS (SELECT * FROM l ORDER BY score DESC, id LIMIT 10),
t AS (SELECT entity_id, max(score) AS s FROM br JOIN a ON a.id = br.event_id GROUP BY entity_id)
SELECT event_id AS id, round(least(1.8, 0.25 * max(s)), 6) AS boost FROM br JOIN t USING (entity_id) WHERE entity_id LIKE 'p%' GROUP BY event_id""")
def shared_topic_boost(spark, d):
    l = T(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") / 10000).alias("score"))
    bridge = A.orders_bridge(spark, d)
    entities = bridge.select(F.col("entity_id").alias("id")).distinct().withColumn("type", F.when(F.col("id").startswith("p"), "OBJECT").otherwise("PERSON"))
    out = retrieval.topic_boost(l.withColumn("ins_seq", F.col("id")), bridge, entities)
    return out.where("topic_boost > 0").select("id", F.round("topic_boost", 6).alias("boost")).distinct()


@query("""WITH s AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 7 = 3 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS conv_id, turn - 1 AS turn, length(text) / 100.0 AS score FROM conversations), a AS (SELECT * FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 5) WHERE conv_id <> '' AND turn >= 0),
b AS (SELECT s.id, max(CASE s.turn - a.turn WHEN 0 THEN least(1.8, 0.22 * a.score) WHEN 1 THEN least(1.5, 0.2 * a.score) WHEN -1 THEN least(1.2, 0.15 * a.score) WHEN 2 THEN least(1.0, 0.12 * a.score) WHEN -2 THEN least(0.7, 0.09 * a.score) ELSE 0 END) AS boost FROM s JOIN a ON s.conv_id = a.conv_id AND abs(s.turn - a.turn) <= 2 WHERE s.conv_id <> '' AND s.turn >= 0 GROUP BY s.id)
SELECT id, round(boost, 6) AS boost FROM b WHERE boost > 0""")
def locality_boost(spark, d):
    c = T(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 7 == 3, "").otherwise(F.col("conv_id").cast("string")).alias("source_session"), (F.col("turn") - 1).alias("source_turn"), (F.length("text") / 100.0).alias("score"))
    return retrieval.locality(c.withColumn("ins_seq", F.col("id"))).where("turn_boost > 0").select("id", F.round("turn_boost", 6).alias("boost"))


# ---- time -----------------------------------------------------------------

DAYS = "epoch_us({a}) / 86400000000.0 - epoch_us(TIMESTAMP '2024-01-28 12:00:00') / 86400000000.0"
DE, DM = f"abs({DAYS.format(a='event_time')})", f"abs({DAYS.format(a='mention_time')})"


def temporal_query(name: str, ask: str, holds: str, bonus: str, anchor: dt.datetime = ANCHOR) -> None:
    hit = f"CASE WHEN {holds.format(t='event_time')} THEN 'event' WHEN {holds.format(t='mention_time')} THEN 'mention' END" if holds else "CASE WHEN event_time IS NOT NULL THEN 'event' ELSE 'mention' END"

    def run(spark, d):
        op = temporal.resolve_query(ask, anchor)
        e = A.events(spark, d)
        found = op.match(F.col("event_time"), F.col("mention_time"))
        return e.select("id", found.alias("anchor"), F.round(op.bonus(F.col("event_time"), F.col("mention_time")), 6).alias("bonus")).where("anchor IS NOT NULL")

    run.__name__ = name
    query(f"WITH {A.EVENTS_SQL}, m AS (SELECT id, {hit} AS anchor, round({bonus}, 6) AS bonus FROM ev) SELECT * FROM m WHERE anchor IS NOT NULL")(run)


NEAR = f"greatest(coalesce(0.15 / (1 + {DE} / 30), 0), 0.08 / (1 + {DM} / 30))"
temporal_query("temporal_dense", "how is it", "", f"0.3 / (1 + {DM} / 30)")
temporal_query("temporal_last_k", "the last time", "", f"0.25 / (1 + coalesce({DE}, {DM}) / 14)")
temporal_query("temporal_in_year", "in 2024", "year({t}) = 2024", "0.0::DOUBLE")
temporal_query("temporal_in_month", "in January 2024", "(year({t}) = 2024 AND month({t}) = 1)", NEAR)
BEFORE = dt.datetime(2023, 12, 20, 12)  # whose winter reaches into the events' month
temporal_query("temporal_in_season", "during the winter", "((year({t}) = 2023 AND month({t}) >= 12) OR (year({t}) = 2024 AND month({t}) <= 2))", NEAR.replace("2024-01-28", "2023-12-20"), BEFORE)
temporal_query("temporal_window", "in the past 3 days", "({t} BETWEEN TIMESTAMP '2024-01-25 12:00:00' AND TIMESTAMP '2024-01-28 12:00:00')", f"greatest(coalesce(0.2 / (1 + {DE} / 14), 0), 0.1 / (1 + {DM} / 14))")
temporal_query("temporal_range_week", "last week", "({t} >= TIMESTAMP '2024-01-15' AND {t} < TIMESTAMP '2024-01-22')", NEAR)
temporal_query("temporal_range_month", "last month", "({t} >= TIMESTAMP '2023-12-01' AND {t} < TIMESTAMP '2024-01-01')", NEAR)


@query(f"WITH {A.EVENTS_SQL}, near AS (SELECT id FROM ev WHERE value > 1e9 AND (year(event_time) = 2024 OR year(mention_time) = 2024)) SELECT id FROM near UNION ALL SELECT id FROM ev WHERE (year(event_time) = 2024 OR year(mention_time) = 2024) AND NOT EXISTS (SELECT 1 FROM near)")
def temporal_fallback(spark, d):
    e = A.events(spark, d)
    return retrieval.temporal_pool(e.where("value > 1e9"), e, temporal.resolve_query("in 2024", ANCHOR)).select("id")


ZH_DIGITS = "一二三四五六七八九"
#: An expression a row, what it says in SQL (b: the base), and the precision.
EXPRESSIONS = [
    ("strftime(b - to_days(n), '%Y-%m-%d')", "CAST(CAST(b - to_days(n) AS DATE) AS TIMESTAMP)", "day"),
    ("'yesterday'", "b - to_days(1)", "day"),
    ("n || ' days ago'", "b - to_days(n)", "day"),
    ("n || ' weeks ago'", "b - to_days(7 * n)", "day"),
    ("n || ' months ago'", "date_trunc('second', b) - to_months(n)", "month"),
    ("'last week'", "b - to_days(7)", "day"),
    ("'last month'", "date_trunc('second', b) - to_months(1)", "month"),
    ("'whenever'", "b", "unknown"),
    ("'last ' || dayname(b - to_days(n))", "b - to_days(CASE WHEN n % 7 = 0 THEN 7 ELSE n % 7 END)", "day"),
    ("'next ' || left(dayname(b + to_days(n)), 3)", "b + to_days(CASE WHEN n % 7 = 0 THEN 7 ELSE n % 7 END)", "day"),
    ("lower(monthname(b)) || ' ' || (2000 + n)", "make_timestamp(2000 + n, month(b), 1, 0, 0, 0.0)", "month"),
    ("'昨天'", "b - to_days(1)", "day"),
    (f"substring('{ZH_DIGITS}', n, 1) || '天前'", "b - to_days(n)", "day"),
    (f"substring('{ZH_DIGITS}', n, 1) || '个月前'", "date_trunc('second', b) - to_months(n)", "month"),
    ("'the week of ' || day(b) || ' ' || monthname(b) || ' ' || year(b)", "CAST(date_trunc('week', b) AS TIMESTAMP)", "day"),
    ("n || ' weekends before ' || day(b) || ' ' || monthname(b) || ' ' || year(b)", "CAST(CAST(b AS DATE) AS TIMESTAMP) - to_days(7 * n)", "day"),
]
EXPR_SQL = "e AS (SELECT event_id, ts AS b, CAST(1 + event_id % 9 AS INTEGER) AS n, CAST((event_id // 9) % " + str(len(EXPRESSIONS)) + " AS INTEGER) AS k FROM events)"


def spelled_times(spark, d) -> DataFrame:
    """event_id, base and expression, one of EXPRESSIONS a row, spelled by Spark."""
    e = T(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("b"), (1 + F.col("event_id") % 9).cast("int").alias("n"), (F.floor(F.col("event_id") / 9) % len(EXPRESSIONS)).cast("int").alias("k"))
    b, n, day = F.col("b"), F.col("n"), lambda t: F.date_format(t, "EEEE")
    ago, ahead = F.date_add(F.to_date("b"), -n), F.date_add(F.to_date("b"), n)
    full = F.concat(F.dayofmonth(b).cast("string"), F.lit(" "), F.date_format(b, "MMMM"), F.lit(" "), F.year(b).cast("string"))
    number, zh = n.cast("string"), F.substring(F.lit(ZH_DIGITS), n, F.lit(1))
    said = [
        F.date_format(ago, "yyyy-MM-dd"), F.lit("yesterday"), F.concat(number, F.lit(" days ago")), F.concat(number, F.lit(" weeks ago")), F.concat(number, F.lit(" months ago")), F.lit("last week"), F.lit("last month"), F.lit("whenever"),
        F.concat(F.lit("last "), day(ago)), F.concat(F.lit("next "), F.left(day(ahead), F.lit(3))), F.concat(F.lower(F.date_format(b, "MMMM")), F.lit(" "), (2000 + n).cast("string")), F.lit("昨天"), F.concat(zh, F.lit("天前")), F.concat(zh, F.lit("个月前")),
        F.concat(F.lit("the week of "), full), F.concat(number, F.lit(" weekends before "), full),
    ]
    return e.select("event_id", "b", F.element_at(F.array(*said), F.col("k") + 1).alias("expr"))


@query(f"WITH {EXPR_SQL} SELECT event_id, CASE k {' '.join(f'WHEN {i} THEN {e}' for i, (e, _, _) in enumerate(EXPRESSIONS))} END AS expr, CASE k {' '.join(f'WHEN {i} THEN CAST({t} AS TIMESTAMP)' for i, (_, t, _) in enumerate(EXPRESSIONS))} END AS resolved, CASE k {' '.join(f'WHEN {i} THEN {p!r}' for i, (_, _, p) in enumerate(EXPRESSIONS))} END AS precision FROM e")
def time_expr_resolve(spark, d):
    got = timeexpr.resolve_column(F.col("expr"), F.col("b"))
    return spelled_times(spark, d).select("event_id", "expr", got.alias("r")).select("event_id", "expr", F.col("r.time").cast("timestamp_ntz").alias("resolved"), "r.precision")


NUMBERS_SQL = "|".join(timeexpr.NUMBERS)
WEEKDAYS_SQL = "|".join(timeexpr.WEEKDAYS)


def _spelled_out(sql: str) -> str:
    for short in sorted(timeexpr.ABBREVIATIONS, key=len, reverse=True):
        sql = f"regexp_replace({sql}, '\\b{short}\\b', '{timeexpr.WEEKDAYS[timeexpr.ABBREVIATIONS[short]]}', 'g')"
    return sql


FACT_SQL = f"SELECT event_id, 'User ' || user_id || ' met them ' || CASE k {' '.join(f'WHEN {i} THEN {e}' for i, (e, _, _) in enumerate(EXPRESSIONS))} END || ' or so' AS f FROM e0"


@query(f"WITH {EXPR_SQL.replace('e AS (SELECT event_id,', 'e0 AS (SELECT event_id, user_id,')}, f AS ({FACT_SQL}), l AS (SELECT event_id, {_spelled_out('lower(f)')} AS f FROM f) SELECT event_id, coalesce({', '.join(f'nullif(regexp_extract(f, {chr(39)}{p}{chr(39)}), {chr(39)}{chr(39)})' for p in timeexpr.EXTRACT)}) AS expr FROM l")
def time_expr_extract(spark, d):
    said = spelled_times(spark, d).join(T(spark, d, "events").select("event_id", "user_id"), "event_id")
    fact = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" met them "), "expr", F.lit(" or so"))
    return said.select("event_id", timeexpr.extract_time(fact).alias("expr"))


#: Questions, and in SQL which facts they let pass.
ASKED = [
    ("what happened last year?", "year({t}) = 2023"), ("anything in 2024?", "year({t}) = 2024"), ("in January 2024?", "year({t}) = 2024 AND month({t}) = 1"), ("during the summer", "year({t}) = 2024 AND month({t}) BETWEEN 6 AND 8"),
    ("recently", "{t} BETWEEN TIMESTAMP '2024-01-28 12:00:00' - to_days(180) AND TIMESTAMP '2024-01-28 12:00:00'"), ("the last time we spoke", "TRUE"), ("how do I fix this error?", "TRUE"),
    ("in the past 3 days", "{t} BETWEEN TIMESTAMP '2024-01-28 12:00:00' - to_days(3) AND TIMESTAMP '2024-01-28 12:00:00'"), ("last week", "{t} >= TIMESTAMP '2024-01-15' AND {t} < TIMESTAMP '2024-01-22'"), ("上个月", "{t} >= TIMESTAMP '2023-12-01' AND {t} < TIMESTAMP '2024-01-01'"),
]


@query(f"WITH {A.EVENTS_SQL} " + " UNION ALL ".join(f"SELECT '{q}' AS q, count(*) AS n FROM ev WHERE coalesce({h.format(t='event_time')}, FALSE) OR {h.format(t='mention_time')}" for q, h in ASKED))
def query_to_operator(spark, d):
    """How many facts each question's operator lets pass."""
    e, out = A.events(spark, d), None
    for q, _ in ASKED:
        op = temporal.resolve_query(q, ANCHOR)
        n = e.agg(F.lit(q).alias("q"), F.count_if(op.match(F.col("event_time"), F.col("mention_time")).isNotNull()).alias("n"))
        out = n if out is None else out.union(n)
    return out


@query("SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS prev FROM orders")
def month_shift_clamp(spark, d):
    shifted = lambda n: timeexpr.month_shift(F.col("o_orderdate").cast("timestamp"), F.lit(n)).cast("date").cast("string")
    return T(spark, d, "orders").select("o_orderkey", shifted(1).alias("next"), shifted(-1).alias("prev"))


@query("SELECT o_orderkey, CAST(make_date(year(o_orderdate) + 1, month(o_orderdate), 1) + CAST(day(o_orderdate) - 1 AS INTEGER) AS VARCHAR) AS next FROM orders")
def year_shift_overflow(spark, d):
    return T(spark, d, "orders").select("o_orderkey", timeexpr.year_shift(F.col("o_orderdate").cast("date"), 1).cast("string").alias("next"))


# ---- conflicts and resolution ----------------------------------------------

FACT = "'user ' || subject || ' ' || predicate || ' value'"
PRED_SQL = f"{A.EVENTS_SQL}, p AS (SELECT n.id AS new_id, o.id AS old_id FROM ev n JOIN ev o ON n.subject = o.subject AND o.ins_seq < n.ins_seq AND n.predicate = o.predicate WHERE NOT n.speech_act AND NOT o.speech_act)"


def conflicts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph, the new events (all of them, as after a bulk load), pairs."""
    e = A.events(spark, d).withColumns({"tokens": F.array("predicate"), "normalized_text": F.concat(F.lit("user "), "subject", F.lit(" "), "predicate"), "superseded_by": F.when(F.col("id") % 9 == 0, F.col("id") + 1)})
    return e, e, conflict.predecessors(e, e)


@query(f"WITH {PRED_SQL} SELECT new_id, count(*) AS n, min(old_id) AS first, max(old_id) AS last FROM p GROUP BY new_id")
def supersede_candidates(spark, d):
    return conflict.predecessor_counts(conflicts(spark, d)[0])


@query(f"WITH {PRED_SQL} SELECT new_id FROM p JOIN ev o ON o.id = old_id JOIN ev n ON n.id = new_id GROUP BY new_id, n.object_value HAVING count(DISTINCT o.object_value) + CASE WHEN bool_or(o.object_value = n.object_value) THEN 0 ELSE 1 END = 2 AND bool_or(o.object_value <> n.object_value)")
def contested_groups(spark, d):
    e, _, pairs = conflicts(spark, d)
    return conflict.contested(pairs, e.withColumns({"object_value": F.col("object_value").cast("string")}))


@query(f"WITH {PRED_SQL} SELECT new_id, arg_min(CASE WHEN o.id % 9 = 0 THEN o.id + 1 END, CASE WHEN o.id % 9 = 0 THEN o.id END) AS inherited FROM p JOIN ev o ON o.id = old_id JOIN ev n ON n.id = new_id WHERE o.object_value = n.object_value GROUP BY new_id")
def remention_guard(spark, d):
    e, _, pairs = conflicts(spark, d)
    return conflict.remention(pairs, e)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN (SELECT max(x.o_orderkey) FROM orders x WHERE x.o_orderkey = CASE WHEN o.o_orderkey % 8 = 0 AND EXISTS (SELECT 1 FROM orders y WHERE y.o_orderkey = o.o_orderkey + 1) THEN o.o_orderkey + 1 ELSE o.o_orderkey + 2 END) END AS superseded_by FROM orders o")
def mark_propagation(spark, d):
    e = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("superseded_by"))
    # two marks each; of those divisible by eight the one to the smaller id comes last
    marks = e.where("id % 4 = 0").select(F.col("id").alias("old_id"), F.explode(F.array((F.col("id") + 2), (F.col("id") + 1))).alias("new_id"))
    marks = marks.where("old_id % 8 = 0 OR new_id = old_id + 2").withColumn("seq", F.col("old_id") * 4 - F.col("new_id"))
    return graph.mark_superseded(e, marks).select("id", "superseded_by")


@query("""WITH n AS (SELECT min(p_partkey) AS id, lower(p_name) AS nm, regexp_extract_all(lower(p_name), '[a-z]+') AS w FROM part GROUP BY p_name), m0 AS (SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 2) AS mention FROM part), m AS (SELECT mention, lower(mention) AS mn, regexp_extract_all(lower(mention), '[a-z]+') AS mw FROM m0),
c AS (SELECT mention, id, 1.0 AS score FROM m, n WHERE contains(mn, nm) OR contains(nm, mn) UNION ALL SELECT mention, id, 0.9 FROM m, n WHERE len(list_intersect(list_filter(mw, lambda x: length(x) >= 3), list_filter(w, lambda x: length(x) >= 3))) > 0),
b AS (SELECT mention, id, max(score) AS score FROM c GROUP BY ALL) SELECT mention, id AS entity_id, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 5""")
def merge_blocking_top5(spark, d):
    """Kinds of parts as a batch of mentions against the names of all parts."""
    p = T(spark, d, "part")
    m = p.select(F.concat("p_type", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")).distinct()
    e = p.groupBy(F.col("p_name").alias("canonical_name")).agg(F.min("p_partkey").alias("id"))
    found = conflict.merge_candidates(m, e)
    return found.select("mention", "entity_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {A.EVENTS_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY value DESC, id) AS pos FROM ev QUALIFY pos <= 200),
s AS (SELECT pos, subject, predicate, row_number() OVER (PARTITION BY subject, predicate ORDER BY pos) AS r FROM k), t AS (SELECT id, subject, predicate, row_number() OVER (PARTITION BY subject, predicate ORDER BY mention_time DESC, pos) AS r FROM k)
SELECT s.pos AS place, t.id FROM s JOIN t USING (subject, predicate, r)""")
def conflict_slot_order(spark, d):
    e = A.events(spark, d).select("id", "subject", "predicate", "mention_time", "value").orderBy(F.desc("value"), "id").limit(200)
    rows = [r.asDict() | {"subject_ids": [r["subject"]]} for r in e.collect()]
    rows.sort(key=lambda r: (-r["value"], r["id"]))
    out = rerank.newest_first(rows, lambda r: set())
    return spark.createDataFrame([(i, r["id"]) for i, r in enumerate(out, 1)], "place long, id long")


@query("""WITH b AS (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents), f AS (SELECT *, max(CASE WHEN used > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS over FROM b) SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM f WHERE over = 0""")
def running_budget(spark, d):
    b = T(spark, d, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    return retrieval.within_budget(b, "source", "doc_id", "n", 20_000).select("source", "doc_id", "used")


@query(f"WITH {A.EVENTS_SQL}, l AS (SELECT id, subject, predicate, lag(predicate) OVER (PARTITION BY subject ORDER BY mention_time, id) AS p FROM ev) SELECT id, subject, predicate FROM l WHERE p IS DISTINCT FROM predicate")
def lag_dedup(spark, d):
    from ..streaming.progress import changed

    return changed(A.events(spark, d), "subject", ["mention_time", "id"], "predicate").select("id", "subject", "predicate")


@query("SELECT p.event_id, s.event_id AS signup FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) s ON p.user_id = s.user_id AND p.ts >= s.ts")
def asof_last_signup(spark, d):
    e = T(spark, d, "events").where(F.col("event_type").isin("purchase", "signup")).withColumn("o", (F.col("event_type") == "purchase").cast("int"))
    return profiles.as_of(e, "user_id", ["ts", "o", "event_id"], "event_type = 'signup'", "event_id").where("event_type = 'purchase'").select("event_id", F.col("as_of").alias("signup"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS prompt FROM events")
def schedule_last_value(spark, d):
    return profiles.as_of(T(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type = 'signup'", "value").select("event_id", F.col("as_of").alias("prompt"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def turn_text(spark, d):
    from ..sources.sessions import joined_lines

    said = joined_lines(T(spark, d, "conversations"), ["conv_id"], "turn", F.concat("role", F.lit(": "), "text"))
    return said.select("conv_id", F.md5("text").alias("digest"), F.col("lines").alias("turns"))


# ---- jobs -----------------------------------------------------------------

LOG_SQL = """lg AS (SELECT conv_id * 100 + turn AS job, conv_id AS session_id, turn, turn * 10 AS seq, 'pending' AS kind FROM conversations UNION ALL SELECT conv_id * 100 + turn, conv_id, turn, turn * 10 + 1, 'failed' FROM conversations WHERE turn % 2 = 1
 UNION ALL SELECT conv_id * 100 + turn, conv_id, turn, turn * 10 + 2, 'settled' FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id * 100 + turn, conv_id, turn, turn * 10 + 3, 'failed' FROM conversations WHERE conv_id % 3 <> 0 AND turn % 2 = 1
 UNION ALL SELECT conv_id * 100 + turn, conv_id, turn, turn * 10 + 4, 'abandoned' FROM conversations WHERE conv_id % 5 = 1)"""


def job_log(spark, d) -> DataFrame:
    c = T(spark, d, "conversations")
    parts = [("pending", 0, "true"), ("failed", 1, "turn % 2 = 1"), ("settled", 2, "conv_id % 3 = 0"), ("failed", 3, "conv_id % 3 <> 0 AND turn % 2 = 1"), ("abandoned", 4, "conv_id % 5 = 1")]
    out = None
    for kind, at, where in parts:
        p = c.where(where).select((F.col("turn") * 10 + at).alias("seq"), F.lit(kind).alias("kind"), F.col("conv_id").alias("session_id"), "turn", (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("job"), F.lit(None).cast("int").alias("failures"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(F.col("turn") * 10 + at).alias("at"))
        out = p if out is None else out.unionByName(p)
    return out


FOLD_SQL = f"{LOG_SQL}, e AS (SELECT *, max(CASE WHEN kind IN ('settled', 'abandoned') THEN seq END) OVER (PARTITION BY session_id, turn) AS done FROM lg), f AS (SELECT session_id, turn, max(CASE WHEN kind = 'pending' THEN job END) AS job, count(*) FILTER (kind = 'failed') AS failures FROM e WHERE done IS NULL OR seq > done GROUP BY ALL HAVING count(*) FILTER (kind = 'pending') > 0)"


@query(f"WITH {FOLD_SQL} SELECT session_id, turn, CAST(job AS VARCHAR) AS job, CAST(failures AS INTEGER) AS failures FROM f")
def job_state_fold(spark, d):
    return jobs.fold(job_log(spark, d)).select("session_id", "turn", "job", "failures")


@query(f"WITH {FOLD_SQL} SELECT (SELECT count(*) FROM f) AS backlog, (SELECT count(*) FROM f WHERE failures > 0) AS failing, (SELECT count(*) FROM lg WHERE kind = 'abandoned') AS abandoned")
def backlog(spark, d):
    return jobs.counts(job_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT NOT EXISTS (SELECT 1 FROM lg p WHERE kind = 'pending' AND NOT EXISTS (SELECT 1 FROM lg s WHERE s.kind = 'settled' AND s.session_id = p.session_id AND s.turn = p.turn)) AS drained")
def drain_check(spark, d):
    return jobs.drained(job_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT session_id, turn, seq FROM lg WHERE kind = 'abandoned' ORDER BY seq * 1000000 + session_id DESC LIMIT 100")
def abandoned_retention(spark, d):
    log = job_log(spark, d).withColumn("seq", F.col("seq") * 1_000_000 + F.col("session_id"))
    return jobs.compacted(log).select("session_id", "turn", F.floor(F.col("seq") / 1_000_000).alias("seq"))


# ---- extraction -----------------------------------------------------------

REPLY_OF = """'Output:' || chr(10) || 'PERSON|c' || o_custkey || '|K' || o_custkey || ', _|likes|' || o_orderpriority || '|yesterday|Customer ' || o_custkey || ' likes it|_|SPEECH' || chr(10)
 || 'T2|OBJECT|o' || o_orderkey || '|||  |_|short' || chr(10) || 'CONCEPT<Music>|x|PREDICATE|OBJECT|_|Music calms ' || o_orderstatus || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'ALIEN|x|y' ELSE 'person|Bob' END || chr(10) || 'Rows: 4'"""


@query("""SELECT o_orderkey, 'PERSON' AS entity_type, 'c' || o_custkey AS canonical, 'K' || o_custkey AS aliases, 'likes' AS predicate, o_orderpriority AS object, 'yesterday' AS time_expr, 'Customer ' || o_custkey || ' likes it' AS fact, TRUE AS speech_act FROM orders
UNION ALL SELECT o_orderkey, 'OBJECT', 'o' || o_orderkey, '', '', '', '', 'short', FALSE FROM orders UNION ALL SELECT o_orderkey, 'CONCEPT', 'Music', 'x', '', '', '', 'Music calms ' || o_orderstatus, FALSE FROM orders
UNION ALL SELECT o_orderkey, 'PERSON', 'Bob', '', '', '', '', '', FALSE FROM orders WHERE o_orderkey % 2 = 1""")
def pipe_row_parse(spark, d):
    out = extraction.parse_rows(T(spark, d, "orders").select("o_orderkey", F.expr(REPLY_OF.replace("chr(10)", "'\\n'")).alias("reply")))
    return out.select("o_orderkey", "entity_type", "canonical", F.array_join("aliases", ",").alias("aliases"), "predicate", "object", "time_expr", "fact", "speech_act")


@query(r"""WITH l AS (SELECT conv_id, turn, trim(unnest(string_split('Ann: ' || text || chr(10) || '  ' || upper(left(role, 1)) || substring(role, 2) || ' Smith: yes' || chr(10) || 'Ann: again', chr(10)))) AS x, generate_subscripts(string_split('Ann: ' || text || chr(10) || '  ' || upper(left(role, 1)) || substring(role, 2) || ' Smith: yes' || chr(10) || 'Ann: again', chr(10)), 1) AS i FROM conversations),
n AS (SELECT conv_id, turn, regexp_extract(x, '^([A-Z][a-zA-Z\s]+):\s', 1) AS n, min(i) AS i FROM l GROUP BY ALL)
SELECT conv_id, turn, string_agg(n, ',' ORDER BY i) AS names, 'PERSON' AS entity_type FROM n WHERE n <> '' GROUP BY conv_id, turn""")
def speaker_coerce(spark, d):
    said = F.concat(F.lit("Ann: "), "text", F.lit("\n  "), F.initcap("role"), F.lit(" Smith: yes\nAnn: again"))
    rows = T(spark, d, "conversations").select("conv_id", "turn", F.lit("ann").alias("canonical"), F.lit("CONCEPT").alias("entity_type"), extraction.speakers(said).alias("speakers"))
    return extraction.coerce_speakers(rows).select("conv_id", "turn", F.array_join("speakers", ",").alias("names"), "entity_type")


SHOWN_SQL = "c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (PERSON)' ELSE ' (OBJECT)' END"


@query(f"""WITH t AS (SELECT n_nationkey AS key, n_nationkey % 7 = 0 AS empty FROM nation), s AS (SELECT c_nationkey AS key, string_agg({SHOWN_SQL}, ', ' ORDER BY {SHOWN_SQL}) AS a FROM customer GROUP BY c_nationkey)
SELECT CAST(t.key AS BIGINT) AS key, CASE WHEN empty OR a IS NULL THEN '(none relevant)' WHEN length(a) > 4000 THEN regexp_replace(left(a, 4000), ',[^,]*$', '') ELSE a END AS names FROM t LEFT JOIN s USING (key)""")
def known_names(spark, d):
    """A text a nation that holds its customers' names; of every seventh an empty one."""
    c = T(spark, d, "customer")
    entities = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("canonical_name"), F.when(F.col("c_custkey") % 2 == 0, "PERSON").otherwise("OBJECT").alias("type"), F.array(F.concat(F.lit("no such "), "c_name")).alias("aliases"), F.col("c_custkey").alias("ins_seq"))
    held = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.upper(F.array_join(F.collect_list("c_name"), " and ")).alias("t"))
    texts = T(spark, d, "nation").join(held, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("key"), F.when(F.col("n_nationkey") % 7 == 0, "").otherwise(F.coalesce("t", F.lit(""))).alias("text"))
    return extraction.known_names(entities, texts)


@query("SELECT string_agg(p_type, ', ' ORDER BY k) AS predicates FROM (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY p_type ORDER BY k LIMIT 60)")
def recorded_predicates(spark, d):
    return extraction.recent_predicates(T(spark, d, "part").select(F.col("p_type").alias("predicate"), F.col("p_partkey").alias("seq")))


# ---- evaluation -----------------------------------------------------------


@query("SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg(quality), 4) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def accuracy_by_type(spark, d):
    judged = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.accuracy(judged, "lang", "quality")


@query("""WITH r AS (SELECT source AS config, quality = 1 AS correct, CASE doc_id % 3 WHEN 0 THEN 'injected' WHEN 1 THEN 'searched' ELSE 'never' END AS recall FROM labels JOIN documents USING (doc_id))
SELECT coalesce(config, 'ALL') AS config, count(*) AS n, count(*) FILTER (recall = 'injected') AS injected, count(*) FILTER (recall = 'searched') AS searched, count(*) FILTER (recall = 'never') AS never, round(100.0 * count(*) FILTER (recall <> 'never') / count(*), 4) AS recall_pct,
CASE WHEN count(*) FILTER (recall = 'injected') > 0 THEN round(100.0 * count(*) FILTER (correct AND recall = 'injected') / count(*) FILTER (recall = 'injected'), 4) ELSE 0.0 END AS injected_acc FROM r GROUP BY ROLLUP (config)""")
def recall_rollup(spark, d):
    r = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", F.col("source").alias("config")), "doc_id")
    m = F.col("doc_id") % 3
    return evaluation.attribution(r.select("config", (F.col("quality") == 1).alias("correct"), F.when(m == 0, "injected").when(m == 1, "searched").otherwise("never").alias("recall")))


@query("SELECT event_type, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input, CAST(sum(event_id % 100) AS BIGINT) AS output, CAST(floor(sum(CAST(floor(value) AS BIGINT)) / count(*)) AS BIGINT) AS avg_input FROM events GROUP BY event_type")
def usage_sums(spark, d):
    e = T(spark, d, "events").select("event_type", F.floor("value").alias("i"), (F.col("event_id") % 100).alias("o"))
    return evaluation.usage(e, "event_type", "i", "o")


@query("SELECT event_type, round(min(value), 6) AS lo, round(avg(value), 6) AS mean, round(max(value), 6) AS hi FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return evaluation.latency(T(spark, d, "events"), "event_type", "value")


@query("SELECT p_brand AS name, count(*) AS calls, count(*) FILTER (p_partkey % 7 = 0 OR p_partkey % 5 = 0) AS failed, count(*) FILTER (p_partkey % 11 = 0) AS suspicious FROM part GROUP BY p_brand")
def tool_call_join(spark, d):
    p = T(spark, d, "part")
    calls = p.select(F.col("p_partkey").alias("call_id"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 11 == 0, "cat answers.json").otherwise(F.lit("ls")).alias("arguments"))
    results = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("call_id"), (F.col("p_partkey") % 5 == 0).alias("is_error"))
    return evaluation.tool_audit(calls, results)


@query("WITH a AS (SELECT DISTINCT split_part(text, ' ', 3) AS answer FROM benchmark WHERE length(split_part(text, ' ', 3)) >= 4), h AS (SELECT answer, text FROM a JOIN documents ON contains(lower(text), lower(answer))) SELECT answer, count(*) FILTER (list_has_any(regexp_extract_all(lower(text), '[a-z]+'), ['thingst', 'reing'])) AS strong, count(*) FILTER (NOT list_has_any(regexp_extract_all(lower(text), '[a-z]+'), ['thingst', 'reing'])) AS weak FROM h GROUP BY answer")
def answers_in_events(spark, d):
    answer = F.split_part("text", F.lit(" "), F.lit(3))
    a = T(spark, d, "benchmark").select(answer.alias("answer")).where(F.length("answer") >= 4).distinct()
    return evaluation.answer_support(a, T(spark, d, "documents").select(F.col("text").alias("fact")), ["thingst", "reing"])


@query("SELECT a.item_id AS pos, length(a.text) AS n, length(b.text) AS reference FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id")
def positional_zip(spark, d):
    b = T(spark, d, "benchmark")
    out = evaluation.paired(b.select(F.col("item_id").alias("pos"), F.col("text").alias("question"), F.length("text").cast("long").alias("n")), b.select(F.col("item_id").alias("pos"), F.col("text").alias("question"), F.length("text").cast("long").alias("answer")))
    return out.select("pos", "n", "reference")


@query("SELECT item_id FROM benchmark WHERE item_id % 5 = 2")
def strided_sample(spark, d):
    """A sampling operator: every fifth question, from the third."""
    return evaluation.strided(T(spark, d, "benchmark"), "item_id", 5, 2).select("item_id")


GLOBS = [("fast", "econ*"), ("here", "*brand#3*"), ("big", "PROMO/*#1"), ("late", "economy/brand*")]


@query("SELECT p_partkey, CASE WHEN r LIKE 'econ%' THEN 'fast' WHEN r LIKE '%brand#3%' THEN 'here' WHEN r LIKE 'promo/%#1' THEN 'big' WHEN r LIKE 'economy/brand%' THEN 'late' ELSE 'default' END AS profile FROM (SELECT p_partkey, lower(p_type || '/' || p_brand) AS r FROM part)")
def profile_match(spark, d):
    return profiles.select_profile(T(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit("/"), "p_brand").alias("route")), GLOBS).select("p_partkey", "profile")


@query("SELECT page_id, kind FROM (SELECT page_id, CASE WHEN regexp_matches(url, '^(?:~|/|\\./|\\.\\./)') THEN 'path' WHEN regexp_matches(url, '(?i)\\.(?:ts|tsx|js|mjs|cjs|json|jsonl|md|yaml|yml|py|sh|txt|html|css)$') THEN 'filename' END AS kind FROM pages)")
def literal_audit(spark, d):
    return T(spark, d, "pages").select("page_id", text.literal_kind(F.col("url")).alias("kind"))


@query(r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[0-9]+\.[0-9]+(?:\.[0-9]+)*')) AS versions, len(regexp_extract_all(text, '[A-Za-z]+_[A-Za-z_]+|[a-z]+[A-Z][A-Za-z]+')) AS identifiers FROM documents")
def corpus_features(spark, d):
    f = evaluation.corpus_features(F.col("text"))
    return T(spark, d, "documents").select("doc_id", *[f[k].cast("long").alias(k) for k in ("chars", "digits", "versions", "identifiers")])


TURNS_SQL = "t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 100, text || CASE WHEN turn % 3 = 0 THEN ' indeed' WHEN turn % 3 = 1 THEN ' and much more of other words that were never said before now' ELSE '' END FROM conversations WHERE turn % 2 = 0)"


@query(f"WITH {TURNS_SQL}, n AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM t) SELECT conv_id, a.turn AS a, b.turn AS b FROM n a JOIN n b USING (conv_id) WHERE a.turn < b.turn AND len(a.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.85 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))")
def near_dup_lines(spark, d):
    """Turns of a conversation, and echoes of every other with words added, whose token
    sets agree to 0.85; a group is one conversation, so pairs stay within its length."""
    c = T(spark, d, "conversations").select("conv_id", "turn", "text")
    more = F.when(F.col("turn") % 3 == 0, " indeed").when(F.col("turn") % 3 == 1, " and much more of other words that were never said before now").otherwise("")
    c = c.union(c.where("turn % 2 = 0").select("conv_id", F.col("turn") + 100, F.concat("text", more)))
    n = c.select("conv_id", "turn", F.array_distinct(text.words_of(F.col("text"))).alias("w"))
    b = n.select("conv_id", F.col("turn").alias("b"), F.col("w").alias("bw"))
    close = n.join(b, "conv_id").where((F.col("turn") < F.col("b")) & (F.size("w") > 0) & (text.jaccard(F.col("w"), F.col("bw")) >= rerank.NEAR_DUP))
    return close.select("conv_id", F.col("turn").alias("a"), "b")


# ---- models, caches, budgets ------------------------------------------------


@query("""WITH d AS (SELECT user_id, lower(event_type || event_id % 9) AS text, CASE event_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'OBJECT' ELSE 'CONCEPT' END AS label, event_id % 4 AS c, event_id, (event_id * 7919 % 100003) / 100003.0 AS score FROM events),
b AS (SELECT user_id, text, arg_max(label, score) AS label, max(score) AS score FROM d WHERE c <> 3 AND score >= 0.5 GROUP BY ALL)
SELECT user_id, text, label, round(CAST(score AS DOUBLE), 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, text) <= 40""")
def detector_filter(spark, d):
    i = F.col("event_id")
    label = F.when(i % 4 == 0, "per").when(i % 4 == 1, "prod").when(i % 4 == 2, "misc").otherwise("time")
    seen = T(spark, d, "events").select("event_id", "user_id", F.concat("event_type", i % 9).alias("text"), label.alias("label"), (i * 7919 % 100003 / 100003.0).alias("score"))
    found = models.mentions(seen, "user_id", {"PER": "PERSON", "PROD": "OBJECT", "MISC": "CONCEPT"}, "event_id")
    return found.select("user_id", "text", "label", F.round("score", 6).alias("score"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 10 = 1")
def stale_vectors(spark, d):
    short = F.when(F.col("vec_id") % 10 == 1, F.slice("embedding", 1, 16)).otherwise(F.col("embedding"))
    e = T(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 != 0, short).alias("v"))
    return e.where(models.stale_vector(F.col("v"), 64)).select("vec_id")


@query(r"SELECT c_custkey, c_custkey % 2 = 0 AS hit FROM customer")
def query_cache(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_name")
    cache = c.where("c_custkey % 2 = 0").select(F.lower("c_name").alias("key"), F.lit("x").alias("value"))
    hits, misses = models.cached(c.withColumn("c_name", F.upper("c_name")), "c_name", cache)
    return hits.select("c_custkey", F.lit(True).alias("hit")).union(misses.select("c_custkey", F.lit(False).alias("hit")))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN floor((o_orderkey % 5000) * 3.0) ELSE o_orderkey % 5000 END AS BIGINT) AS budget, CAST(floor(60 * (1 + 0.2 * (2 * ((o_orderkey % 10) / 10.0) - 1)) + 0.5) AS BIGINT) AS delay FROM orders")
def budgets_and_delays(spark, d):
    k = F.col("o_orderkey")
    budget = models.max_tokens(k % 5000, F.lit(models.HEADROOM), k % 2 == 0)
    return T(spark, d, "orders").select("o_orderkey", budget.cast("long").alias("budget"), models.retry_delay(F.lit(60), (k % 10) / 10.0).alias("delay"))


@query(f"WITH {A.EVENTS_SQL} SELECT id, round(value * CASE WHEN speech_act THEN 0.3 ELSE 1.0 END, 6) AS score FROM ev")
def speech_discount(spark, d):
    return A.events(spark, d).select("id", F.round(F.col("value") * retrieval.speech_factor(F.col("speech_act")), 6).alias("score"))


# ---- files, names, merges, rounds, injection --------------------------------


@query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events), n AS (SELECT count(*) AS n FROM events),
d AS (SELECT event_id FROM events WHERE event_id % 7 = 0), r AS (SELECT event_id, (SELECT n FROM n) + (SELECT count(*) FROM d) + row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events WHERE event_id % 35 = 0)
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS normalized_text, seq AS ins_seq FROM a JOIN events USING (event_id) WHERE event_id % 7 <> 0 UNION ALL SELECT CAST(event_id AS VARCHAR), event_type || ' again', seq FROM r JOIN events USING (event_id)""")
def journal_files(spark, d):
    """A journal written as files in three appends, read back in order and replayed."""
    from ..sources import journal

    path = A.scratch(spark, "journal")
    e = T(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("normalized_text"), "event_id")
    again = e.where("event_id % 35 = 0").withColumn("normalized_text", F.concat("normalized_text", F.lit(" again")))
    for op, rows in (("event.add", e), ("event.delete", e.where("event_id % 7 = 0")), ("event.add", again)):
        journal.append(graph.records(op, rows).withColumn("seq", F.col("data.id").cast("long")), path)
    return journal.live(journal.read_journal(spark, path), "event").select("id", "normalized_text", "ins_seq")


@query("""WITH e AS (SELECT n_nationkey AS id, n_name FROM nation WHERE n_nationkey % 2 = 0), o AS (SELECT id, c_custkey AS seq, 0 AS pos, upper(n_name) AS a FROM customer JOIN e ON c_nationkey = id UNION ALL SELECT id, c_custkey, 1, '  Alias  ' || c_custkey % 3 FROM customer JOIN e ON c_nationkey = id UNION ALL SELECT id, c_custkey, 2, 'old' FROM customer JOIN e ON c_nationkey = id),
f AS (SELECT id, lower(regexp_replace(trim(a), '\\s+', ' ', 'g')) AS n, arg_min(regexp_replace(trim(a), '\\s+', ' ', 'g'), (seq, pos)) AS a, min((seq, pos)) AS met FROM o GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS id, 'Old,' || string_agg(a, ',' ORDER BY met) AS aliases FROM f JOIN e USING (id) WHERE n <> lower(n_name) AND n <> 'old' GROUP BY id""")
def alias_accretion(spark, d):
    """Customers mention their nation by its name and by aliases; every second nation is known."""
    n = T(spark, d, "nation")
    known = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("canonical_name"), F.lit("CONCEPT").alias("type"), F.array(F.lit("Old")).alias("aliases"), F.col("n_nationkey").cast("long").alias("ins_seq"))
    c = T(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    mentions = c.select(F.upper("n_name").alias("name"), F.lit("PERSON").alias("type"), F.array(F.concat(F.lit("  Alias  "), F.col("c_custkey") % 3), F.lit("old")).alias("aliases"), F.col("c_custkey").alias("seq"))
    resolved, _ = graph.resolve_or_create(mentions, known)
    return graph.accrete(resolved, known).select("id", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS id, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS person FROM nation")
def lookup_by_name(spark, d):
    """Nations by their names in another spelling; every second is an entity, every fourth a person."""
    n = T(spark, d, "nation")
    e = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("canonical_name"), F.when(F.col("n_nationkey") % 4 == 0, "PERSON").otherwise("OBJECT").alias("type"), F.array().cast("array<string>").alias("aliases"), F.col("n_nationkey").cast("long").alias("ins_seq"))
    asked = n.select("n_nationkey", F.concat(F.lit(" "), F.lower("n_name")).alias("name"))
    found = graph.find_by_name(asked, "name", e).select("n_nationkey", "id")
    return found.join(graph.find_by_name(asked, "name", e, "PERSON").select("n_nationkey", F.col("id").alias("person")), "n_nationkey")


@query(ORACLE_SQL["merge_blocking_top5"].replace("SELECT mention, id AS entity_id, round(CAST(score AS DOUBLE), 6) AS score, row_number()", "SELECT mention AS name, (SELECT p_name FROM part WHERE p_partkey = id) AS canonical, row_number()").replace("FROM b QUALIFY rank <= 5", "FROM b WHERE length(mention) % 2 = 0 QUALIFY rank = 1"))
def adjudicated_merges(spark, d):
    """An adjudicator that is sure of the first candidate of names of even length."""
    p = T(spark, d, "part")
    m = p.select(F.concat("p_type", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")).distinct().withColumns({"type": F.lit("OBJECT"), "sample_fact": F.lit("a part")})
    e = p.groupBy(F.col("p_name").alias("canonical_name")).agg(F.min("p_partkey").alias("id")).withColumns({"type": F.lit("OBJECT"), "aliases": F.array().cast("array<string>")})
    return conflict.find_merges(m, e, sure_of_the_first).withColumn("rank", F.lit(1).cast("long"))


def sure_of_the_first(lines: list[tuple]) -> str:
    return "\n".join(f"{i}: 1: {'sure' if len(line[0]) % 2 == 0 else 'unsure'}" for i, line in enumerate(lines, 1))


@query("SELECT o_orderkey AS id, lower(p_name) AS object_value FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS k FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = k")
def object_value(spark, d):
    """The name of each order's first part."""
    entities = T(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("p_name")).alias("canonical_name"))
    return conflict.object_values(order_events(spark, d), entities).select("id", "object_value")


SPLIT_EVENTS = "ev2 AS (SELECT *, predicate || CASE WHEN id % 2 = 0 THEN '_made' ELSE '_done' END AS p2 FROM ev)"


@query(f"WITH {A.EVENTS_SQL}, {SPLIT_EVENTS} SELECT n.id AS new_id, count(*) AS n, min(o.id) AS first FROM ev2 n JOIN ev2 o ON n.subject = o.subject AND o.ins_seq < n.ins_seq WHERE NOT o.speech_act AND len(list_intersect(string_split(n.p2, '_'), string_split(o.p2, '_'))) > 0 GROUP BY n.id")
def widened_predecessors(spark, d):
    e = A.events(spark, d).withColumn("predicate", F.concat("predicate", F.when(F.col("id") % 2 == 0, "_made").otherwise("_done")))
    return conflict.widened(e, e).groupBy("new_id").agg(F.count("*").alias("n"), F.min("old_id").alias("first"))


RESULT_SQL = f"{FOLD_SQL}, r AS (SELECT session_id, turn, job, failures, turn % 3 = 0 AS ok FROM f)"


@query(f"WITH {RESULT_SQL} SELECT CASE WHEN ok THEN 'settled' WHEN failures + 1 >= 3 THEN 'abandoned' ELSE 'failed' END AS kind, session_id, turn, CAST(CASE WHEN NOT ok THEN failures + 1 END AS INTEGER) AS failures, CASE WHEN NOT ok THEN 'down' END AS error FROM r")
def round_booked(spark, d):
    """Results of a round of all outstanding jobs; three rounds are the cap."""
    log = job_log(spark, d)
    results = jobs.fold(log).select("session_id", "turn", (F.col("turn") % 3 == 0).alias("ok"), F.lit("down").alias("error"))
    return jobs.booked(log, results, "2026-09-01 12:00:00", cap=3).select("kind", "session_id", "turn", "failures", "error")


@query(f"WITH {FOLD_SQL} SELECT CASE WHEN failures >= 2 THEN 'abandoned' ELSE 'pending' END AS kind, session_id, turn, CASE WHEN failures < 2 THEN CAST(job AS VARCHAR) END AS job, CAST(failures AS INTEGER) AS failures FROM f WHERE failures > 0")
def retry_pass(spark, d):
    return jobs.requeued(job_log(spark, d), "2026-09-01 12:00:00", cap=2, failed_only=True).select("kind", "session_id", "turn", "job", "failures")


@query(f"WITH {FOLD_SQL}, t AS (SELECT DISTINCT conv_id AS session_id, turn FROM conversations) SELECT t.session_id, t.turn FROM t ANTI JOIN f ON f.session_id = t.session_id AND f.turn = t.turn")
def new_jobs(spark, d):
    """Turns that aren't outstanding: settled and abandoned ones are free again."""
    turns = T(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.lit("j").alias("job"))
    return jobs.enqueued(turns.union(turns), job_log(spark, d)).select("session_id", "turn")


@query(f"WITH {FOLD_SQL} SELECT session_id, turn, 3.0 * (row_number() OVER (ORDER BY turn, session_id) - 1) AS start_after FROM f")
def paced_starts(spark, d):
    state = jobs.fold(job_log(spark, d)).withColumn("order", F.struct("turn", "session_id"))
    return jobs.paced(state, "order").select("session_id", "turn", "start_after")


MESSAGES_SQL = "m AS (SELECT conv_id AS session_id, turn // 4 AS turn, 1 + turn % 4 // 3 AS step, turn AS pos, CASE WHEN turn % 5 = 4 THEN 'plugin' ELSE role END AS kind, turn % 5 = 4 AND conv_id % 2 = 0 AS own, role = 'user' AS claimed, CASE WHEN turn % 5 = 4 THEN 'block' ELSE text END AS text FROM conversations)"


def messages(spark, d) -> DataFrame:
    """Four rows of a conversation as a turn of two steps; every fifth row is a plugin's,
    in even conversations this engine's."""
    c, plugin = T(spark, d, "conversations"), F.col("turn") % 5 == 4
    return c.select(F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 4).alias("turn"), (1 + F.floor(F.col("turn") % 4 / 3)).cast("int").alias("step"), F.col("turn").alias("pos"), F.when(plugin, "plugin").otherwise(F.col("role")).alias("kind"), F.when(plugin, F.when(F.col("conv_id") % 2 == 0, "tessera").otherwise("other")).alias("plugin"), (F.col("role") == "user").alias("claimed"), F.when(plugin, "block").otherwise(F.col("text")).alias("text"))


@query(f"WITH {MESSAGES_SQL}, q AS (SELECT session_id, turn, arg_max(trim(text), pos) AS raw FROM m WHERE step = 1 AND claimed AND kind = 'user' AND trim(text) <> '' GROUP BY ALL) SELECT session_id, turn, md5(raw) AS query FROM q WHERE length(raw) <= 250")
def turn_questions(spark, d):
    """Questions of at most 250 characters; none here has a question mark, so they stay whole."""
    from ..streaming import inject

    return inject.asked(messages(spark, d), 250).select("session_id", "turn", F.md5("query").alias("query"))


@query(f"""WITH {MESSAGES_SQL}, t AS (SELECT session_id, turn, max(CASE WHEN claimed THEN pos END) AS last, bool_or(own) AS has FROM m WHERE step = 1 GROUP BY ALL),
b AS (SELECT session_id, turn, step, CAST(pos AS DOUBLE) AS pos, kind, text FROM m UNION ALL SELECT session_id, turn, 1, coalesce(last + 0.5, -0.5), 'plugin', 'memories of ' || session_id FROM t WHERE NOT has)
SELECT session_id, turn, row_number() OVER (PARTITION BY session_id, turn ORDER BY step, pos) - 1 AS pos, kind, md5(text) AS text FROM b""")
def turn_injection(spark, d):
    from ..streaming import inject

    m = messages(spark, d)
    blocks = m.select("session_id", "turn").distinct().withColumn("block", F.concat(F.lit("memories of "), F.col("session_id").cast("string")))
    return inject.spliced(m, blocks).select("session_id", "turn", F.col("pos").cast("long").alias("pos"), "kind", F.md5("text").alias("text"))


@query("""SELECT o_orderstatus AS prompt, count(*) AS turns, CAST(sum(3 + o_orderkey % 2) AS BIGINT) AS events, CAST(sum(3 + o_orderkey % 2) AS BIGINT) AS entities, CAST(sum(2 + o_orderkey % 2) AS BIGINT) AS empty_core, CAST(sum(1 - o_orderkey % 2) AS BIGINT) AS parse_fail_lines, 3 * count(*) AS column_mismatch, CAST(0 AS BIGINT) AS literal_rows, CAST(sum(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM orders GROUP BY o_orderstatus""")
def quality_by_prompt(spark, d):
    """Saved replies scored again and summed by prompt; every tenth turn mentions a name."""
    o = T(spark, d, "orders")
    outputs = o.select(F.col("o_orderstatus").alias("prompt"), F.col("o_orderkey").alias("turn"), F.expr(REPLY_OF.replace("chr(10)", "'\\n'")).alias("reply"), F.when(F.col("o_orderkey") % 10 == 0, "of Music").otherwise("plain").alias("turn_text"))
    scored = evaluation.score_outputs(outputs, ["prompt", "turn"], ["Music"])
    covered = scored.groupBy("prompt").agg(F.count_if(F.col("name_coverage") == 1).alias("covered"))
    kept = ["events", "entities", "empty_core", "parse_fail_lines", "column_mismatch", "literal_rows"]
    return evaluation.quality_summary(scored, ["prompt"]).select("prompt", "turns", *kept).join(covered, "prompt")


@query("SELECT unnest(string_split(p_name, ' ')) AS category, count(*) AS n FROM part GROUP BY 1")
def category_histogram(spark, d):
    return evaluation.histogram(T(spark, d, "part").select(F.split("p_name", " ").alias("words")), "words")


@query("SELECT o_orderpriority AS profile, count(*) FILTER (o_orderkey % 3 <> 0) AS merges, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> o_orderkey % 3) AS wrong, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AS missed FROM orders GROUP BY ALL")
def wrong_merge_counts(spark, d):
    k = F.col("o_orderkey")
    none = lambda c: F.when(c != 0, c)
    return evaluation.wrong_merges(T(spark, d, "orders").select(F.col("o_orderpriority").alias("profile"), none(k % 3).alias("target"), none(k % 5).alias("expected")))


@query("SELECT count(*) AS events, count(*) FILTER (event_id % 4 <> 0) AS extracted FROM events")
def query_volume(spark, d):
    turn = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, -1)).otherwise(F.col("event_id"))
    return evaluation.query_volume(T(spark, d, "events").select(turn.alias("source_turn")))


@query(r"SELECT p_partkey, lower(trim(regexp_replace('Where  is the ' || p_name || chr(10) || '?', '\s+', ' ', 'g'))) AS question FROM part")
def question_unwrap(spark, d):
    asked = F.concat(F.lit("Where  is the "), "p_name", F.lit("\n?"))
    wrapped = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Current Date: x, Now Answer the Question:"), asked, F.lit(" Answer: "))).otherwise(asked)
    return T(spark, d, "part").select("p_partkey", evaluation.unwrapped(wrapped).alias("question"))


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(c_mktsegment), 'urgent') OR contains(lower(c_name), 'urgent')")
def links_with_text(spark, d):
    o = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    links = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("predicate"), F.col("c_name").alias("source_name"), F.col("c_mktsegment").alias("target_name"), F.col("o_orderstatus").alias("fact"), F.col("o_orderdate").cast("string").alias("label"))
    return graph.by_time_label(graph.text_filter(links, "Urgent")).select("id")


@query(r"SELECT conv_id, turn, w AS text, CAST(length(w) AS DOUBLE) AS score, 1 AS detector FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM conversations WHERE NOT contains(text, 'z')) WHERE length(w) >= 12")
def detected_mentions(spark, d):
    """The first detector answers nothing, the second long words; texts with a z fail in both."""
    c = T(spark, d, "conversations").select("conv_id", "turn", "text")
    return models.detect(c, "text", [no_detector, long_words]).select("conv_id", "turn", "text", "score", "detector")


def no_detector(text_: str) -> list | None:
    return None


def long_words(text_: str) -> list[tuple]:
    import re

    if "z" in text_:
        raise ValueError("z")
    return [(w, "WORD", float(len(w))) for w in re.findall("[a-z]+", text_) if len(w) >= 12]


HEAD = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(3)]


@query("SELECT vec_id, " + ", ".join(f"round(tanh(list_dot_product(embedding::DOUBLE[], [{', '.join(map(str, w))}]::DOUBLE[]) + {0.1 * i}), 6) AS d{i}" for i, w in enumerate(HEAD)) + " FROM embeddings")
def dense_head(spark, d):
    got = models.dense(F.col("embedding").cast("array<double>"), HEAD, [0.1 * i for i in range(3)])
    return T(spark, d, "embeddings").withColumn("d", got).select("vec_id", *[F.round(F.col("d")[i], 6).alias(f"d{i}") for i in range(3)])


POOLED_SQL = "CASE WHEN vec_id % 2 = 0 THEN (e[{i}] + e[{i} + 16] + e[{i} + 32]) / 3 ELSE (e[{i}] + e[{i} + 32]) / 2 END"


@query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, [{', '.join(POOLED_SQL.format(i=i) for i in range(1, 17))}] AS m FROM v) SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 5) AS first, round(m[16] / sqrt(list_dot_product(m, m)), 5) AS last FROM m")
def token_pooling(spark, d):
    """Three token vectors a row, the second masked in every other."""
    tokens = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(3)])
    mask = F.array(F.lit(1), (1 - F.col("vec_id") % 2).cast("int"), F.lit(1))
    got = T(spark, d, "embeddings").withColumn("p", models.mean_pool(tokens, mask))
    return got.select("vec_id", F.round(F.col("p")[0], 5).alias("first"), F.round(F.col("p")[15], 5).alias("last"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 4))), 4) AS total FROM embeddings")
def rounded_vectors(spark, d):
    total = F.aggregate(vectors.rounded(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return T(spark, d, "embeddings").select("vec_id", F.round(total, 4).alias("total"))


@query("""WITH a AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 500)
SELECT id, min(list) AS list, arg_min(place, list) AS place FROM (SELECT id, 0 AS list, place FROM a UNION ALL SELECT id, 1, place FROM b) GROUP BY id""")
def candidate_union(spark, d):
    """All purchases by id, then the 500 events of highest value: an id keeps its first place."""
    e = T(spark, d, "events").withColumn("id", F.col("event_id"))
    bought = e.where("event_type = 'purchase'").select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("place"))
    best = e.orderBy(F.desc("value"), "id").limit(500).select("id", F.row_number().over(Window.orderBy(F.desc("value"), "id")).cast("long").alias("place"))
    return retrieval.candidate_union(bought, best).select("id", "place.list", "place.place")


@query(f"""{KEYED}, h AS (SELECT m.id, CASE WHEN m.id % 2 = 0 AND e.vec_id IS NOT NULL THEN list_cosine_similarity(e.embedding::DOUBLE[], {VSQL}) ELSE CAST(k AS DOUBLE) END * CASE WHEN m.id % 3 = 0 THEN 0.3 ELSE 1.0 END AS s FROM m LEFT JOIN embeddings e ON e.vec_id = m.id)
SELECT id, round(s, 6) AS score FROM (SELECT * FROM h ORDER BY s DESC, id LIMIT 60) WHERE s > 0""")
def mixed_slice(spark, d):
    """Cosine where a fact has a vector, the raw overlap where it has none, less for speech."""
    v = T(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "embedding")
    facts = T(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ins_seq"), F.col("text").alias("event_text"), (F.col("doc_id") % 3 == 0).alias("speech_act"))
    return retrieval.dense_slice(facts.join(v, "id", "left"), VECTOR, WORDS, 60).select("id", F.round("dense", 6).alias("score"))


@query(f"""WITH {A.EVENTS_SQL} SELECT id, round((value / 100 + 2 * (id % 10) / 10.0 + id % 3 + 0.5 * (id % 2) + CASE WHEN id % 4 = 0 THEN 0.5 ELSE 0 END + 0.3 / (1 + {DM} / 30)) * CASE WHEN speech_act THEN 0.3 ELSE 1.0 END * CASE WHEN id % 5 = 0 THEN 0.3 ELSE 1.0 END, 6) AS score FROM ev""")
def composed_score(spark, d):
    i = F.col("id")
    parts = {"dense": F.col("value") / 100, "overlap": (i % 10) / 10.0, "expansion_bonus": i % 3, "descriptor_bonus": 0.5 * (i % 2), "mentioned": i % 4 == 0, "superseded_by": F.when(i % 5 == 0, i)}
    scored = retrieval.compose(A.events(spark, d).withColumns(parts), temporal.resolve_query("how is it", ANCHOR))
    return scored.select("id", F.round("score", 6).alias("score"))


# ---- order-dependent and streaming operators: tests hold them to plain versions


@query()
def mmr_topk(spark, d):
    """Diverse re-ranking of the 50 best by cosine, on the rows that the limit has cut."""
    score = vectors.cosine(F.col("embedding").cast("array<double>"), VCOL())
    top = T(spark, d, "embeddings").select("vec_id", "embedding", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(50).collect()
    picked = rerank.mmr(sorted([r.asDict() for r in top], key=lambda r: (-r["score"], r["vec_id"])), 10)
    return spark.createDataFrame([(i, r["vec_id"], round(r["score"], 6)) for i, r in enumerate(picked, 1)], "place long, vec_id long, score double")


@query()
def progress_projection(spark, d):
    """Events as to-do snapshots and goals per user, projected to state events."""
    from ..streaming.progress import project_batch

    e = T(spark, d, "events")
    todo = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("content"), F.lit("pending").alias("status"))).alias("todos")))
    goal = F.to_json(F.struct(F.lit("create").alias("operation"), F.struct(F.col("event_type").alias("objective")).alias("goal")))
    kind = F.when(F.col("event_id") % 4 == 0, "goal/change").otherwise("todo/write")
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ins_seq"), kind.alias("type"), F.when(F.col("event_id") % 4 == 0, goal).otherwise(todo).alias("payload"))
    return project_batch(rows)


@query()
def extract_pipeline(spark, d):
    """Turns through cap, segment, a stub model, the parser and the quality gate."""
    turns = T(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("turn_text"), F.lit(0).cast("timestamp").alias("mention_time"))
    return extraction.extract(turns, stub_model).select("session_id", "turn", "part", "row_no", "entity_type", "canonical", "fact")


def stub_model(prompt: str) -> str:
    words = prompt.split()
    return f"CONCEPT|{words[0]}|_|says|_|_|{' '.join(words[:8])}" if words else ""
