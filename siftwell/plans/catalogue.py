"""Registered queries, each beside its SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell import clients
from siftwell.functions import chunking as ch
from siftwell.functions import text as tx
from siftwell.functions import vectors as vx
from siftwell.operators import browse, observe, prompts, rag, ranking, rules, search, smart, store
from siftwell.session import ship
from siftwell.sources import loaders
from siftwell.streaming import telemetry

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-06-01 00:00:00"


def _query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        _QUERIES[fn.__name__] = run
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c, n: int = 6):
    return F.round(c, n)


def _signed_r(c, n: int):
    """``round`` as SQL has it: halves of the scaled double go away from 0, and what is below 0 keeps its sign (-0.0, which ``F.round`` makes 0.0)."""
    scaled = c * 10.0**n
    whole = F.rint(scaled)
    return F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole) / 10.0**n


# --- vectors and search ----------------------------------------------------------------------------


def _vectors(t):
    return t("embeddings").select("vec_id", vx.as_double(F.col("embedding")).alias("embedding"), "label")


def _topk(t, ids: str, k: int, docs=None, **options):
    v = _vectors(t)
    q = v.where(ids).select(F.col("vec_id").alias("query_id"), "embedding")
    return search.top_k(q, docs if docs is not None else v, k, order="vec_id", **options).select("query_id", "rank", "vec_id", _r(F.col("score")).alias("score"))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"


def _topk_sql(ids: str, k: int, where: str = "true", score: str = _COS, floor: str = "true") -> str:
    return f"""SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id, {score} AS s FROM embeddings q, embeddings d WHERE q.{ids} AND {where})
      WHERE {floor}) WHERE rank <= {k}"""


@_query(_topk_sql("vec_id % 50 = 0", 10))
def cosine_topk(t):
    return _topk(t, "vec_id % 50 = 0", 10)


@_query(_topk_sql("vec_id % 50 = 0", 5))
def cosine_topk_batch(t):
    return _topk(t, "vec_id % 50 = 0", 5)


@_query(_topk_sql("vec_id % 50 = 0", 10, "d.label = 3"))
def filtered_topk(t):
    return _topk(t, "vec_id % 50 = 0", 10, _vectors(t).where("label = 3"))


@_query(_topk_sql("vec_id % 50 = 0", 10, "d.label >= 2 AND d.label < 6"))
def function_filter_topk(t):
    return _topk(t, "vec_id % 50 = 0", 10, search.apply_filter(_vectors(t), lambda c: (c >= 2) & (c < 6), meta="label"))


@_query(_topk_sql("vec_id % 50 = 0", 20, floor="s >= 0.1"))
def min_score_search(t):
    return _topk(t, "vec_id % 50 = 0", 20, min_score=0.1)


@_query("SELECT vec_id, 0.0::DOUBLE AS zero_score, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_score FROM embeddings")
def cosine_zero_guard(t):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return _vectors(t).select("vec_id", vx.cosine(F.col("embedding"), zero).alias("zero_score"), _r(vx.cosine(F.col("embedding"), F.col("embedding"))).alias("self_score"))


@_query(f"""SELECT query_id, count(*) FILTER (same) AS same_label, count(*) AS k FROM (
  SELECT q.vec_id AS query_id, q.label = d.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, d.vec_id) AS rank
  FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0) WHERE rank <= 10 GROUP BY query_id""")
def knn_label_vote(t):
    v = _vectors(t)
    hits = search.top_k(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 10, order="vec_id")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return hits.join(own, "query_id").groupBy("query_id").agg(F.count_if(F.col("own") == F.col("label")).alias("same_label"), F.count("*").alias("k"))


_MRL = "list_transform(range(16), lambda i: list_avg(embedding[i * 4 + 1 : i * 4 + 4]::DOUBLE[]))"


@_query(f"SELECT vec_id, list_transform(m, lambda x: round(x / sqrt(list_sum(list_transform(m, lambda y: y * y))), 5)) AS reduced FROM (SELECT vec_id, {_MRL} AS m FROM embeddings)")
def mrl_reduce_16(t):
    return _vectors(t).select("vec_id", F.transform(vx.mrl_reduce(F.col("embedding"), 16, 64), lambda x: _signed_r(x, 5)).alias("reduced"))


@_query(f"""SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(q.m, d.m) AS s FROM (SELECT vec_id, {_MRL} AS m FROM embeddings) q, (SELECT vec_id, {_MRL} AS m FROM embeddings) d
  WHERE q.vec_id % 50 = 0)) WHERE rank <= 5""")
def mrl_topk(t):
    v = _vectors(t).withColumn("embedding", vx.mrl_reduce(F.col("embedding"), 16, 64))
    hits = search.top_k(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 5, order="vec_id")
    return hits.select("query_id", "rank", "vec_id", _r(F.col("score")).alias("score"))


def _char_sql(text: str, dim: int) -> str:
    """The embedding of a text, whose characters are split off once."""
    raw = f"list_transform(range({dim}), lambda j: coalesce(list_sum(list_transform(range(j + 1, len(cs) + 1, {dim}), lambda p: cs[p])), 0.0))"
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::DOUBLE)"
    return f"SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS e FROM (SELECT doc_id, {raw} AS v FROM (SELECT doc_id, {codes} AS cs FROM documents WHERE {text} <> ''))"


@_query(f"SELECT doc_id, list_transform(e, lambda x: round(x, 5)) AS embedding FROM ({_char_sql('text', 8)})")
def char_embed(t):
    return t("documents").where("text <> ''").select("doc_id", F.transform(vx.char_embed(F.col("text"), 8), lambda x: F.round(x, 5)).alias("embedding"))


@_query(f"""WITH e AS ({_char_sql("text", 16)}) SELECT query_id, rank, doc_id, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM (
    SELECT q.doc_id AS query_id, d.doc_id, list_cosine_similarity(q.e, d.e) AS s FROM e q, e d WHERE q.doc_id % 50 = 0)) WHERE rank <= 5""")
def text_search_topk(t):
    docs = t("documents").where("text <> ''").select("doc_id", "text")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    hits = search.text_search(docs, asked, 5, lambda x: vx.char_embed(x, 16), order="doc_id")
    return hits.select("query_id", "rank", "doc_id", _r(F.col("score")).alias("score"))


# --- text ------------------------------------------------------------------------------------------

_Q = "the latest stupid report"
_TERMS = f"list_filter(string_split('{_Q}', ' '), lambda t: length(t) > 2)"
_FOUND = f"list_filter({_TERMS}, lambda t: contains(lower(text), t))"


@_query("SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: length(t) > 2) AS terms FROM conversations")
def query_terms(t):
    return t("conversations").select("conv_id", "turn", tx.query_terms(F.col("text")).alias("terms"))


@_query(f"SELECT doc_id, {_FOUND} AS matched_terms, len({_FOUND}) AS match_count, round(len({_FOUND}) / len({_TERMS}), 6) AS match_ratio, 'Matched query with similarity score of 50.0%' AS reason FROM documents")
def explain(t):
    rows = search.with_explanation(t("documents").withColumn("query", F.lit(_Q)).withColumn("score", F.lit(0.5)))
    e = "explanation."
    return rows.select("doc_id", F.col(e + "matchedTerms").alias("matched_terms"), F.col(e + "matchCount").alias("match_count"), _r(F.col(e + "matchRatio")).alias("match_ratio"), F.col(e + "reason").alias("reason"))


@_query(f"SELECT doc_id, round(len({_FOUND}) / len({_TERMS}), 6) AS keyword_match FROM documents")
def keyword_match(t):
    return t("documents").select("doc_id", _r(ranking.keyword_match(F.lit(_Q), F.col("text"))).alias("keyword_match"))


@_query("SELECT page_id, regexp_extract_all(html, 'href=\"(.*?)\"', 1) AS links, regexp_extract_all('<loc>' || url || '</loc>', '<loc>(.*?)</loc>', 1) AS locs FROM pages")
def sitemap_locs(t):
    return t("pages").select("page_id", F.regexp_extract_all("html", F.lit('href="(.*?)"'), F.lit(1)).alias("links"), tx.sitemap_locs(F.concat(F.lit("<loc>"), "url", F.lit("</loc>"))).alias("locs"))


def _nested(text: str, steps) -> str:
    for pattern, to in steps:
        flags = "g" + ("is" if "(?is)" in pattern else "i" if "(?i)" in pattern else "") + ("m" if "(?m)" in pattern else "")
        plain = pattern.replace("(?is)", "").replace("(?i)", "").replace("(?m)", "(?m)").replace("'", "''")
        text = f"regexp_replace({text}, '{plain}', '{to.replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', '{flags.replace('m', '')}')".replace("\\n\\n', '", "\\n\\n', '")
    return text


_HTML = [(p, to if to != "\n\n" else "@@") for p, to in tx.HTML_STEPS]


@_query("SELECT page_id, regexp_replace(" + _nested("html", _HTML).replace("'@@'", "chr(10) || chr(10)") + r", '^\s+|\s+$', '', 'g') AS text FROM pages")
def html_to_text(t):
    return t("pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


_MD = "'# Title ' || doc_id || chr(10) || '**bold** and *it* `c' || '` [l](http://x) ```' || chr(10) || 'x = 1' || chr(10) || '``` ' || text || chr(10) || '```' || chr(10) || '```'"


@_query("SELECT doc_id, " + _nested(f"({_MD})", tx.MARKDOWN_STEPS) + " AS text FROM documents")
def strip_markdown(t):
    md = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n**bold** and *it* `c` [l](http://x) ```\nx = 1\n``` "), F.col("text"), F.lit("\n```\n```"))
    return t("documents").select("doc_id", tx.strip_markdown(md).alias("text"))


@_query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(lower(text[1:100]), '^\\s+|\\s+$', '', 'g') ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedup_fingerprint(t):
    w = W.partitionBy(tx.fingerprint(F.col("text"))).orderBy("doc_id")
    return t("documents").withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id")


@_query("""SELECT event_type, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(event_type, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c + 2147483648 + 4294967296 * 32) % 4294967296 - 2147483648) AS hash, count(*) AS n FROM events GROUP BY event_type""")
def hash32(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", tx.hash32(F.col("event_type")).alias("hash"), "n")


# --- chunks ----------------------------------------------------------------------------------------


@_query("""SELECT doc_id, i // 450 AS chunk_index, regexp_replace(text[i + 1 : i + 500], '^\\s+|\\s+$', '', 'g') AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_windows(t):
    return t("documents").where("length(text) > 0").select("doc_id", F.posexplode(ch.windows(F.col("text"), 500, 450)).alias("chunk_index", "chunk"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1|', 'g'), '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@_query(f"""WITH s AS (SELECT doc_id, text, {_SENT} AS s FROM documents WHERE text <> ''), c AS (
  SELECT doc_id, CASE WHEN len(s) <= 5 THEN [text] ELSE list_transform(list_filter(range(0, len(s), 4), lambda i: i = 0 OR i - 4 + 5 < len(s)), lambda i: array_to_string(s[i + 1 : i + 5], ' ')) END AS c FROM s)
  SELECT doc_id, unnest(range(len(c))) AS chunk_index, unnest(c) AS chunk FROM c""")
def chunk_sentences(t):
    return t("documents").select("doc_id", F.posexplode(ch.chunk_sentences(F.col("text"))).alias("chunk_index", "chunk"))


_PACK = """SELECT doc_id, text, list_reduce(list_prepend({'cur': '', 'out': []::VARCHAR[]}, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: {'cur': x, 'out': []::VARCHAR[]})),
  lambda a, x: CASE WHEN length(x.cur) > 500 THEN {'cur': '', 'out': list_concat(CASE WHEN trim(a.cur) <> '' THEN list_append(a.out, trim(a.cur)) ELSE a.out END,
      list_transform(range(0, length(x.cur), 450), lambda i: trim(x.cur[i + 1 : i + 500])))}
    WHEN length(a.cur) + length(x.cur) + 1 <= 500 THEN {'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || x.cur END, 'out': a.out}
    ELSE {'cur': x.cur, 'out': CASE WHEN trim(a.cur) <> '' THEN list_append(a.out, trim(a.cur)) ELSE a.out END} END) AS st FROM documents WHERE text <> ''"""
_PACKED = f"SELECT doc_id, CASE WHEN length(text) <= 500 THEN [text] WHEN trim(st.cur) <> '' THEN list_append(st.out, trim(st.cur)) ELSE st.out END AS c FROM ({_PACK})"


@_query(f"SELECT doc_id, unnest(range(len(c))) AS chunk_index, unnest(c) AS chunk FROM ({_PACKED})")
def chunk_text(t):
    return t("documents").select("doc_id", F.posexplode(ch.chunk_text(F.col("text"), 500, 50, "\n")).alias("chunk_index", "chunk"))


_FENCED = "text || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || text"
_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@_query(f"""WITH m AS (SELECT doc_id, {_FENCED} AS t FROM documents), st AS (SELECT doc_id, t,
  list_reduce(list_prepend({{'cur': '', 'open': false, 'out': []::VARCHAR[]}}, list_transform(string_split(t, chr(10)), lambda x: {{'cur': x, 'open': false, 'out': []::VARCHAR[]}})),
    lambda a, x: CASE WHEN a.open = starts_with({_TRIMMED.format("x.cur")}, '```') AND length(a.cur) + length(x.cur) + 1 > 1000 AND a.cur <> ''
      THEN {{'cur': array_to_string(string_split(a.cur, chr(10))[-2:], chr(10)) || chr(10) || x.cur || chr(10), 'open': false, 'out': list_append(a.out, {_TRIMMED.format("a.cur")})}}
      ELSE {{'cur': a.cur || x.cur || chr(10), 'open': a.open <> starts_with({_TRIMMED.format("x.cur")}, '```'), 'out': a.out}} END) AS r FROM m),
  c AS (SELECT doc_id, list_filter(CASE WHEN length(t) <= 1000 THEN [t] ELSE list_append(r.out, {_TRIMMED.format("r.cur")}) END, lambda x: x <> '') AS c FROM st)
  SELECT doc_id, unnest(range(len(c))) AS chunk_index, unnest(c) AS chunk FROM c""")
def chunk_markdown(t):
    md = F.concat("text", F.lit("\n```\n"), "text", F.lit("\n```\n"), "text")
    return t("documents").select("doc_id", F.posexplode(ch.chunk_markdown(md)).alias("chunk_index", "chunk"))


@_query(f"SELECT doc_id::VARCHAR || '_chunk_' || chunk_index AS chunk_id, doc_id AS original_id, chunk_index, n AS total_chunks, source FROM (SELECT p.doc_id, d.source, len(c) AS n, unnest(range(len(c))) AS chunk_index FROM ({_PACKED}) p JOIN documents d USING (doc_id))")
def chunk_documents_meta(t):
    out = ch.chunk_documents(t("documents"), "doc_id", size=500, overlap=50, separator="\n")
    return out.select("chunk_id", "original_id", "chunk_index", "total_chunks", "source")


@_query(f"SELECT count(*) AS chunks, max(length(x)) AS longest, round(avg(length(x)), 6) AS mean_length FROM (SELECT unnest(c) AS x FROM ({_PACKED}))")
def chunk_stats(t):
    rows = t("documents").select(F.explode(ch.chunk_text(F.col("text"), 500, 50, "\n")).alias("x"))
    return rows.agg(F.count("*").alias("chunks"), F.max(F.length("x")).alias("longest"), _r(F.avg(F.length("x"))).alias("mean_length"))


# --- ranking ---------------------------------------------------------------------------------------

_KINDS = ["official docs", "Documentation", "research lab", "my blog", "tutorial", "forum", "social", "else"]
_SRC = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_QUAL = "CASE " + " ".join(f"WHEN contains(lower(src), '{p}') THEN {v}" for p, v in ranking.SOURCE_QUALITY) + " ELSE 0.5 END"
_DAY = "(TIMESTAMP '2024-06-01' - to_days((doc_id % 700)::INT))"
_REC = "greatest(0.1, exp(-((doc_id % 700)::DOUBLE) / 180))"


def _candidates(t):
    src = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 8 + 1).cast("int"))
    day = F.date_format(F.expr("timestampadd(DAY, -cast(doc_id % 700 as int), timestamp'2024-06-01 00:00:00')"), "yyyy-MM-dd HH:mm:ss")
    return t("documents").select("doc_id", "text", src.alias("source"), day.alias("date"), (F.col("doc_id") % 97 / 96.0).alias("score"))


@_query(f"SELECT doc_id, {_QUAL}::DOUBLE AS quality FROM (SELECT doc_id, {_SRC} AS src FROM documents)")
def source_quality(t):
    return _candidates(t).select("doc_id", ranking.source_quality(F.col("source")).alias("quality"))


@_query(f"SELECT doc_id, round({_REC}, 6) AS recency FROM documents")
def recency(t):
    return _candidates(t).select("doc_id", _r(ranking.recency(F.col("date"), F.lit(AS_OF).cast("timestamp"))).alias("recency"))


_BASE = f"SELECT doc_id, text, src, (doc_id % 97) / 96.0::DOUBLE AS score, len({_FOUND}) / len({_TERMS}) AS kw, {_REC} AS rec, {_QUAL}::DOUBLE AS q FROM (SELECT *, {_SRC} AS src FROM documents)"
_WEIGHTED = f"SELECT *, 0.5 * score + 0.2 * kw + 0.15 * rec + 0.1 * q + 0.05 * 0.5 AS weighted FROM ({_BASE})"


def _scored(t):
    rows = _candidates(t)
    return ranking.score(
        rows,
        {
            "semanticSimilarity": F.col("score"), "keywordMatch": ranking.keyword_match(F.lit(_Q), F.col("text")), "recency": ranking.recency(F.col("date"), F.lit(AS_OF).cast("timestamp")),
            "sourceQuality": ranking.source_quality(F.col("source")), "contextRelevance": F.lit(0.5),
        },
    )


@_query(f"SELECT doc_id, round(weighted, 6) AS weighted_score FROM ({_WEIGHTED})")
def weighted_score(t):
    return _scored(t).select("doc_id", _r(F.col("weighted_score")).alias("weighted_score"))


@_query(f"SELECT doc_id, round(0.5 * score, 6) AS semantic, round(0.2 * kw, 6) AS keyword, round(0.15 * rec, 6) AS recent, round(0.1 * q, 6) AS quality, 0.025::DOUBLE AS context FROM ({_BASE})")
def score_breakdown(t):
    names = {"semanticSimilarity": "semantic", "keywordMatch": "keyword", "recency": "recent", "sourceQuality": "quality", "contextRelevance": "context"}
    return _scored(t).select("doc_id", *(_r(F.col(f"score_breakdown.{k}.contribution")).alias(v) for k, v in names.items()))


@_query("""SELECT doc_id, final_rank FROM (SELECT doc_id, row_number() OVER (ORDER BY round(weighted, 9) DESC, doc_id) AS final_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(text[1:100]), '^\\s+|\\s+$', '', 'g') ORDER BY round(weighted, 9) DESC, doc_id) AS n FROM (""" + _WEIGHTED + ")) WHERE n = 1) WHERE final_rank <= 20")
def smart_retrieval(t):
    rows = _scored(t).withColumn("weighted_score", F.round("weighted_score", 9)).withColumn("query_id", F.lit(0)).withColumn("rank", F.col("doc_id"))
    best = ranking.remove_duplicates(rows)
    # One query, so the best are taken by a heap in each task; a window would bring all rows to one.
    top = best.orderBy(F.desc("weighted_score"), "rank").limit(20)
    return top.withColumn("final_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weighted_score"), "rank"))).select("doc_id", "final_rank")


_CANDIDATES = f"""SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({_COS}, 12) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND d.vec_id IN (SELECT doc_id FROM documents)"""
#: Weights that the time-sensitive rule changes, and which are then divided by their sum.
_NEWS = "(0.35 * score + 0.2 * kw + 0.4 * rec + 0.1 * q + 0.05 * 0.5) / 1.1"


@_query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_CANDIDATES})),
  b AS (SELECT c.query_id, c.doc_id, c.rank, c.score, text, len({_FOUND}) / len({_TERMS}) AS kw, {_REC} AS rec, {_QUAL}::DOUBLE AS q
        FROM c JOIN (SELECT *, {_SRC} AS src FROM documents) d USING (doc_id) WHERE c.rank <= 10),
  w AS (SELECT *, round({_NEWS}, 9) AS weighted FROM b),
  u AS (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(lower(text[1:100]), '^\\s+|\\s+$', '', 'g') ORDER BY weighted DESC, rank) AS n FROM w)
  SELECT query_id, final_rank, doc_id, round(weighted, 6) AS weighted_score, rules FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, rank) AS final_rank, 'boost-recent-for-news' AS rules FROM u WHERE n = 1) WHERE final_rank <= 5""")
def smart_retriever(t):
    v, d = _vectors(t), _candidates(t).drop("score").withColumnRenamed("doc_id", "vec_id")
    docs = v.join(d, "vec_id")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit(_Q).alias("query"), "embedding")
    retriever = smart.create_smart_retriever(search.Retriever(docs, order="vec_id"))
    got = retriever.get_relevant(asked, 5, as_of=F.lit(AS_OF).cast("timestamp"), weights=dict(ranking.DEFAULT_WEIGHTS))
    said = got.decisions.select("query_id", F.array_join("applied_rules", ",").alias("rules"))
    return got.results.join(said, "query_id").select("query_id", "final_rank", F.col("vec_id").alias("doc_id"), _r(F.col("weighted_score")).alias("weighted_score"), "rules")


@_query(f"""SELECT query_id, round(avg(score), 6) AS similarity, round(avg(rec), 6) AS recency, round(avg(q), 6) AS source_quality, round(avg(kw), 6) AS coverage
  FROM (SELECT *, doc_id // 5 AS query_id FROM ({_BASE})) GROUP BY query_id""")
def answer_quality(t):
    rows = _scored(t).withColumn("query_id", F.floor(F.col("doc_id") / 5))
    return ranking.answer_quality(rows).select("query_id", *(_r(F.col(c)).alias(c) for c in ("similarity", "recency", "source_quality", "coverage")))


@_query(f"SELECT doc_id FROM ({_BASE}) WHERE NOT (regexp_matches(lower(src), 'social|forum|comment') AND score < 0.6)")
def critical_filter(t):
    return ranking.drop_low_quality(_candidates(t)).select("doc_id")


@_query(f"SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'idiot') AS boosted, round(CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'idiot') THEN least(1.0, score + 0.05 * (contains(lower(text), 'the')::INT + contains(lower(text), 'idiot')::INT)) ELSE score END, 6) AS score FROM ({_BASE})")
def pattern_boost(t):
    return ranking.boost(_candidates(t), ["the", "idiot"]).select("doc_id", "boosted", _r(F.col("score")).alias("score"))


# --- rules and history -----------------------------------------------------------------------------


@_query("SELECT conv_id, turn, regexp_matches(text, '\\b(latest|new|recent|current|today)\\b', 'i') AS news, len(string_split(text, ' ')) = 1 AS short, regexp_matches(text, '\\b(code|api|function|error|bug)\\b', 'i') AS technical FROM conversations")
def query_rules(t):
    return t("conversations").select("conv_id", "turn", *rules.query_flags(F.col("text")))


def _history(t):
    c = t("conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("query"), (F.col("conv_id") % 6).cast("int").alias("feedback"), F.size(F.split("text", " ", -1)).alias("query_length"), (F.col("turn") % 10 / 10.0).alias("avg_score"))


_HIST = "SELECT conv_id * 1000 + turn AS seq, text AS query, (conv_id % 6)::INT AS feedback, len(string_split(text, ' ')) AS query_length, (turn % 10) / 10.0::DOUBLE AS avg_score FROM conversations WHERE role = 'user'"


@_query(f"""SELECT term, count(*) AS n FROM (SELECT seq, unnest(range(len(w))) AS p, unnest(w) AS term FROM (SELECT seq, string_split(query, ' ') AS w FROM ({_HIST}) WHERE feedback >= 4))
  WHERE (SELECT count(*) > 10 FROM ({_HIST}) WHERE feedback >= 4) GROUP BY term HAVING count(*) >= 3 ORDER BY n DESC, min({{'o': seq, 'p': p}}) LIMIT 10""")
def pattern_mining(t):
    return rules.mine_patterns(_history(t))


@_query(f"SELECT seq, query_length FROM ({_HIST}) ORDER BY seq DESC LIMIT 100")
def history_last_100(t):
    return rules.bounded_history(_history(t), [F.col("seq")]).select("seq", "query_length")


@_query(f"SELECT count(*) AS total_queries, round(avg(query_length), 2) AS avg_query_length, round(avg(avg_score), 3) AS avg_score, round(coalesce(avg(CASE WHEN feedback > 0 THEN feedback END), 0.0), 2) AS avg_rating, count(CASE WHEN feedback > 0 THEN 1 END) AS rated FROM ({_HIST})")
def insights(t):
    return rules.insights(_history(t))


@_query(f"SELECT count(*) FILTER (query_length <= 2 AND avg_score < 0.6) > 5 AS expand_short_queries FROM ({_HIST})")
def short_query_rule(t):
    return rules.too_many_short(_history(t))


# --- store -----------------------------------------------------------------------------------------


def _stored(t):
    return t("documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("seq"))


@_query("""SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id ELSE doc_id END::VARCHAR AS id, CASE WHEN doc_id % 10 = 0 THEN 'new ' || doc_id ELSE text END AS text, doc_id AS seq FROM documents
  UNION ALL SELECT 'x1', 'late', (SELECT max(doc_id) FROM documents) + 1 + 9000000""")
def upsert(t):
    spark = t("documents").sparkSession
    changed = _stored(t).where("seq % 10 = 0").select("id", F.concat(F.lit("new "), "id").alias("text"), F.col("seq").alias("batch_seq"))
    more = spark.createDataFrame([("x1", "early", 9000000), ("x1", "late", 9000001)], "id string, text string, batch_seq long")
    return store.upsert(_stored(t), changed.unionByName(more))


@_query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE text END AS text, lang, CASE WHEN doc_id % 7 = 0 THEN 'b' END AS extra FROM documents")
def update_merge(t):
    docs = t("documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("meta"))
    change = t("documents").where("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("changed").alias("text"), F.create_map(F.lit("extra"), F.lit("b")).alias("meta"))
    out = store.update(docs, change)
    return out.select("id", "text", F.col("meta")["lang"].alias("lang"), F.col("meta")["extra"].alias("extra"))


@_query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 3 <> 0")
def delete(t):
    return store.delete(_stored(t), _stored(t).where("seq % 3 = 0")).select("id")


@_query("SELECT doc_id::VARCHAR AS id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def page(t):
    return store.page(_stored(t), 100, 50).select("id")


@_query("SELECT doc_id::VARCHAR AS id, text, doc_id AS seq FROM documents WHERE doc_id = 7")
def get_document(t):
    return browse.get(_stored(t), "7")


@_query("SELECT count(*) AS count, 64 AS dimension FROM embeddings")
def stats(t):
    return store.stats(_vectors(t), "vec_id")


# --- prompts ---------------------------------------------------------------------------------------


def _hits(t):
    """Five documents a query, whole; every document is a hit of one."""
    return t("documents").select(F.floor(F.col("doc_id") / 5).alias("query_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("rank"), (F.col("doc_id") % 97 / 97.0).alias("score"), "text", F.concat(F.lit("q"), F.floor(F.col("doc_id") / 5).cast("string")).alias("query"), F.create_map(F.lit("source"), "source").alias("meta"))


_ONE = "'Doc ' || (doc_id % 5 + 1)::INT || ' (score: ' || printf('%.3f', (doc_id % 97) / 97.0::DOUBLE) || ') [source=' || source || ']:' || chr(10) || text"
_CTX = f"SELECT doc_id // 5 AS query_id, string_agg({_ONE}, chr(10) || chr(10) ORDER BY doc_id) AS context FROM documents GROUP BY 1"


@_query(_CTX)
def context_concat(t):
    return prompts.context(_hits(t), scores=True, meta="meta")


def _prompt(name: str) -> None:
    def make(t):
        ctx = prompts.context(_hits(t), scores=True, meta="meta").withColumn("query", F.concat(F.lit("q"), F.col("query_id").cast("string")))
        return prompts.PromptManager(name, system="Be exact.").generate(ctx).select("query_id", "prompt")

    make.__name__ = f"prompt_{name}"
    text = prompts.TEMPLATES[name].replace("'", "''").replace("\n", "' || chr(10) || '")
    filled = "'" + text.replace("{c}", "' || context || '").replace("{q}", "' || 'q' || query_id || '") + "'"
    _query(f"SELECT query_id, 'Be exact.' || chr(10) || chr(10) || {filled} AS prompt FROM ({_CTX})")(make)


for _name in prompts.TEMPLATES:
    _prompt(_name)


@_query(f"SELECT query_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: q' || query_id || chr(10) || chr(10) || 'Answer based on the context:' AS prompt, 'Answer based on the context:' AS response FROM ({_CTX})")
def rag_answers(t):
    return rag.generate_with_rag(_hits(t), clients.Echo(), "echo", scores=True, meta="meta").select("query_id", "prompt", "response")


@_query(f"SELECT query_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: q' || query_id || chr(10) || chr(10) || 'Answer:' AS prompt FROM ({_CTX})")
def rag_text_template(t):
    ctx = prompts.context(_hits(t), scores=True, meta="meta").withColumn("query", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    return rag.default_prompt(ctx, "technical").select("query_id", "prompt")


_OLD = "'Doc ' || (doc_id % 5 + 1)::INT || ' (score=' || printf('%.3f', (doc_id % 97) / 97.0::DOUBLE) || '):' || chr(10) || text"


@_query(f"SELECT doc_id // 5 AS query_id, chr(10) || 'Context:' || chr(10) || string_agg({_OLD}, chr(10) || chr(10) ORDER BY doc_id) || chr(10) || chr(10) || 'User: q' || (doc_id // 5) || chr(10) || 'Assistant:' AS prompt FROM documents GROUP BY doc_id // 5")
def legacy_prompt(t):
    return prompts.legacy_prompt(_hits(t))


@_query(f"SELECT query_id, replace('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: q' || query_id || chr(10) || chr(10) || 'Answer based on the context:', '{{tone}}', 'calm') AS prompt FROM ({_CTX})")
def prompt_variables(t):
    ctx = prompts.context(_hits(t), scores=True, meta="meta").withColumn("query", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    manager = prompts.PromptManager("there is none of this name", variables={"tone": "calm"}).clone()
    return manager.generate(ctx).select("query_id", "prompt")


@_query(f"SELECT query_id, CASE WHEN length(context) > 900 THEN context[1:900] || chr(10) || '...(truncated)' ELSE context END AS context FROM ({_CTX})")
def context_max_length(t):
    return prompts.context(_hits(t), scores=True, meta="meta", max_length=900)


# --- loaders ---------------------------------------------------------------------------------------


def _files(t, ending: str, content):
    return t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(ending)).alias("path"), F.encode(content, "UTF-8").alias("content"))


@_query("SELECT doc_id || '.json' AS path, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN doc_id::VARCHAR ELSE 'true' END AS text, 'json' AS format FROM documents WHERE text <> ''")
def load_json(t):
    value = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("body")))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("doc_id").cast("double").alias("body")))).otherwise(F.lit('{"body": true}'))
    files = _files(lambda n: t(n).where("text <> ''"), ".json", value)
    return loaders.parse_files(files, text_field="body").select("path", "text", "format")


@_query("SELECT doc_id || '.txt' AS path, text, doc_id || '.txt' AS file_name, 'utf-8' AS encoding FROM documents WHERE text IS NOT NULL")
def load_text(t):
    rows = loaders.parse_files(_files(lambda n: t(n).where("text IS NOT NULL"), ".txt", F.col("text")))
    return rows.select("path", "text", F.col("meta")["fileName"].alias("file_name"), F.col("meta")["encoding"].alias("encoding"))


@_query("SELECT doc_id || '.md' AS path, " + _nested("('# Head' || chr(10) || '**b** ' || text)", tx.MARKDOWN_STEPS) + " AS text, 'markdown' AS format FROM documents WHERE text IS NOT NULL")
def load_markdown(t):
    md = F.concat(F.lit("# Head\n**b** "), "text")
    return loaders.parse_files(_files(lambda n: t(n).where("text IS NOT NULL"), ".md", md), strip=True).select("path", "text", "format")


@_query("SELECT url, regexp_replace(" + _nested("html", _HTML).replace("'@@'", "chr(10) || chr(10)") + r", '^\s+|\s+$', '', 'g') AS text, 'url' AS format FROM pages")
def load_pages(t):
    return loaders.load_pages(t("pages").select("url", "html")).select("url", "text", F.col("meta")["format"].alias("format"))


# --- events ----------------------------------------------------------------------------------------


@_query("""SELECT event_type AS kind, count(*) AS total, round(sum(coalesce(value, 0)) / count(*), 2) AS avg_duration, round(sum(user_id % 7 / 7.0::DOUBLE) / count(*), 2) AS avg_top_score,
  round(sum(coalesce(value / 2, 0)) / count(*), 2) AS avg_tokens_per_second, sum(user_id)::BIGINT AS total_doc_count FROM events GROUP BY event_type""")
def metrics_report(t):
    rows = t("events").select(F.col("event_type").alias("kind"), F.col("value").alias("duration"), (F.col("user_id") % 7 / 7.0).alias("top_score"), (F.col("value") / 2).alias("tokens_per_second"), F.col("user_id").alias("doc_count"))
    return observe.metrics_report(rows)


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
  s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return telemetry.sessions(t("events"), "6 hours").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@_query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k::INT) AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL")
def sliding_counts(t):
    rows = telemetry.windowed_counts(t("events"), slide="30 minutes")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_query("SELECT event_type, count(*) AS total, round(sum(coalesce(value, 0)) / count(*), 2) AS avg_value, round(sum(coalesce(value, 0)), 2) AS sum_value FROM events GROUP BY event_type")
def metrics_summary(t):
    return observe.metrics_summary(t("events"), "event_type", "value")


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


@_query("SELECT user_id, count(*) AS total, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id")
def session_summary(t):
    return observe.session_summary(t("events"), "user_id").select("user_id", "total", "duration_us", F.coalesce(F.col("counts")["click"], F.lit(0)).alias("clicks"))


@_query("SELECT event_id FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def events_in_range(t):
    e = t("events")
    first = e.agg(F.min("ts")).scalar()
    return e.where((F.col("ts") >= first + F.expr("INTERVAL 1 DAY")) & (F.col("ts") <= first + F.expr("INTERVAL 3 DAYS"))).select("event_id")


@_query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running_avg FROM events")
def running_avg(t):
    return rules.running_average(t("events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", F.round("running_avg", 9).alias("running_avg"))


@_query("SELECT event_id, event_id || ',' || event_type || ',' || props AS line FROM events")
def telemetry_csv(t):
    return t("events").select("event_id", observe.telemetry_csv(F.col("event_id").cast("string"), F.col("event_type"), F.col("props")).alias("line"))


@_query("SELECT event_id FROM events WHERE (props->>'$.k')::BIGINT = 5")
def json_meta_filter(t):
    return search.apply_filter(t("events").withColumn("meta", F.parse_json("props")), {"k": 5}).select("event_id")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def windowed_counts(t):
    return telemetry.windowed_counts(t("events")).withColumn("value", F.round("value", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- conversations and browsing --------------------------------------------------------------------


@_query("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY conv_id")
def conversation_summary(t):
    return browse.conversation_summary(t("conversations")).withColumn("mean_length", _r(F.col("mean_length")))


@_query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def conversation_export(t):
    return browse.transcripts(t("conversations"))


@_query("SELECT conv_id, turn, role, text FROM conversations")
def conversation_round_trip(t):
    return browse.import_conversations(browse.export_conversations(t("conversations"))).withColumn("turn", F.col("turn").cast(t("conversations").schema["turn"].dataType))


@_query("SELECT DISTINCT lang AS category FROM documents WHERE lang <> ''")
def distinct_categories(t):
    return browse.categories(t("documents"), "lang")


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND lang = 'en' AND source = 'src1'")
def doc_browser_filter(t):
    return browse.browse(t("documents"), "license", lang="en", source="src1").select("doc_id")


@_query("SELECT coalesce(nullif(lang, ''), 'unknown') AS kind, count(*) AS n FROM documents GROUP BY 1")
def type_distribution(t):
    return browse.type_distribution(t("documents"), "lang")
