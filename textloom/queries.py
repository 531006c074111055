"""Registered queries of the retrieval operators, over the documents table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BASE, STEM, STOP, STOP_STEM, Analyzer
from .functions.stem import stem_vocabulary
from .functions.text import alpha_tokens, basic_tokens
from .operators import boolean, index, rank, stats, weights
from .plans import sql
from .sources.collection import documents, query_set
from .sources.sinks import run_lines

CONFIGS = {"base": BASE, "stop": STOP, "stem": STEM, "stopstem": STOP_STEM}
BASIC = Analyzer(tokenizer="basic")
QUERY = "thing ering ing under"
TOPICS = {1: QUERY, 2: "stand other thation", 3: "ment avec nous", 4: "ung heit schen", 5: "the of and", 6: "erand thering unders", 7: "que ción para"}
DOC, DOC_IDS = 0, [0, 1, 2, 3, 4]
TERMS = ["the", "thing", "that", "under", "ering"]
QUERY_VECTOR = {"the": 1.0, "thing": 0.0, "that": 0.0, "under": 0.0, "ering": 1.0}
TAG = "textloom"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str) -> None:
    _QUERIES[name], _ORACLES[name] = query, oracle


def _built(spark: SparkSession, sf_dir: str, config: Analyzer = BASE) -> index.Index:
    return index.build_index(documents(spark, sf_dir), config)


def _r(name: str):
    return F.round(name, 6).alias(name)


def _words(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.search(_built(spark, sf_dir), QUERY, "bm25")


# Text functions ---------------------------------------------------------------------------------

_add(
    "tok_alpha",
    lambda s, d: documents(s, d).select("doc_id", F.explode(alpha_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")),
    f"WITH {sql.TOKENS} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
)
_add(
    "tok_basic",
    lambda s, d: documents(s, d).select("doc_id", F.explode(basic_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")),
    f"WITH {sql.BASIC} SELECT doc_id, term, tf FROM basic",
)
for _name, _config in CONFIGS.items():
    _add(f"terms_{_name}", lambda s, d, c=_config: _built(s, d, c).postings.select("term", "doc_id", "tf"), f"{sql.index(_name)} SELECT term, doc_id, CAST(tf AS BIGINT) AS tf FROM post")
_add("stem_vocab", lambda s, d: stem_vocabulary(_built(s, d).postings), f"WITH {sql.OCC['stem']} SELECT term, stem FROM stems")


def _query_terms_sql(config: str) -> str:
    topics = ", ".join(f"({k}, '{q}')" for k, q in TOPICS.items())
    base = f"WITH documents AS (SELECT * FROM (VALUES {topics}) t(doc_id, text)), {sql.OCC[config]}"
    return f"{base} SELECT DISTINCT CAST(doc_id AS BIGINT) AS query_id, term FROM {'occ2' if 'stem' in config else 'occ'}"


_add("query_terms", lambda s, d: rank.query_table(query_set(s, TOPICS), STOP_STEM), _query_terms_sql("stopstem"))

# Index ------------------------------------------------------------------------------------------

_add("index_tf", lambda s, d: _built(s, d).postings.select("term", "doc_id", "tf"), f"{sql.index()} SELECT term, doc_id, tf FROM post")
_add("index_df", lambda s, d: _built(s, d).terms, f"{sql.index()} SELECT term, df FROM df")
_add(
    "postings_list",
    lambda s, d: index.postings_lists(_built(s, d)).select("term", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids")),
    f"{sql.index()} SELECT term, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM post GROUP BY term",
)
_add(
    "index_dictionary",
    lambda s, d: index.dictionary(_built(s, d)).select("term", F.array_join(F.transform(F.map_entries("postings"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("postings")),
    f"{sql.index()} SELECT term, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM post GROUP BY term",
)
_add(
    "index_dump",
    lambda s, d: index.dump(_built(s, d), with_tf=True),
    f"""{sql.index()} SELECT term, CAST(0 AS BIGINT) AS line_no, df || '=df(' || term || ')' AS line FROM df
UNION ALL SELECT term, row_number() OVER (PARTITION BY term ORDER BY doc_id), '    ' || tf || ' ' || doc_id FROM post""",
)
_add("token_sequence", lambda s, d: index.token_sequence(documents(s, d)), f"WITH {sql.TOKENS} SELECT term, doc_id FROM tok")
_add("doc_lengths", lambda s, d: _built(s, d).docs, f"{sql.index()} SELECT doc_id, CAST(dl AS BIGINT) AS dl FROM dl")
_add("collection_scalars", lambda s, d: _built(s, d).scalars.withColumn("avg_doc_length", F.round("avg_doc_length", 6)), f"{sql.index()} SELECT doc_count, total_terms, round(avg_doc_length, 6) AS avg_doc_length FROM n")
_add(
    "incidence_matrix",
    lambda s, d: index.incidence_matrix(_built(s, d), TERMS, DOC_IDS),
    f"{sql.index()} SELECT term, " + ", ".join(f"CAST(max((doc_id = {i})::INT) AS INT) AS doc_{i}" for i in DOC_IDS) + f" FROM post WHERE term IN ({_words(TERMS)}) AND doc_id IN ({', '.join(map(str, DOC_IDS))}) GROUP BY term",
)
_add(
    "count_matrix",
    lambda s, d: index.count_matrix(_built(s, d), TERMS, DOC_IDS),
    f"{sql.index()} SELECT doc_id, " + ", ".join(f"CAST(coalesce((SELECT tf FROM post p WHERE p.doc_id = dl.doc_id AND term = '{t}'), 0) AS BIGINT) AS tf_{t}" for t in TERMS) + f", CAST(dl AS BIGINT) AS dl FROM dl WHERE doc_id IN ({', '.join(map(str, DOC_IDS))})",
)

# Statistics -------------------------------------------------------------------------------------

for _name in ("base", "stop", "stem"):
    _add(
        f"stats_occ_{_name}",
        lambda s, d, c=CONFIGS[_name]: stats.occurrence_statistics(_built(s, d, c)).select(_r("avg_document_length"), _r("avg_term_length"), "vocabulary_size", "total_documents", "total_tokens"),
        f"""{sql.index(_name)} SELECT round(avg_doc_length, 6) AS avg_document_length, round((SELECT sum(len(term) * tf) / sum(tf) FROM post), 6) AS avg_term_length,
(SELECT count(*) FROM df) AS vocabulary_size, doc_count AS total_documents, total_terms AS total_tokens FROM n""",
    )
for _name in ("base", "stopstem"):
    _add(
        f"stats_vocab_{_name}",
        lambda s, d, c=CONFIGS[_name]: stats.vocabulary_statistics(documents(s, d), _built(s, d, c)).select("total_tokens", "distinct_tokens", _r("avg_token_length"), "total_terms", "distinct_terms", _r("avg_doc_length"), _r("avg_term_length")),
        f"""{sql.index(_name)} SELECT (SELECT count(*) FROM tok) AS total_tokens, (SELECT count(DISTINCT token) FROM tok) AS distinct_tokens,
round((SELECT avg(len(token)) FROM (SELECT DISTINCT token FROM tok)), 6) AS avg_token_length, total_terms, (SELECT count(*) FROM df) AS distinct_terms,
round(avg_doc_length, 6) AS avg_doc_length, round((SELECT avg(len(term)) FROM df), 6) AS avg_term_length FROM n""",
    )


def _experiment_sql() -> str:
    parts = []
    for name in CONFIGS:
        parts.append(
            f"""SELECT * FROM ({sql.index(name)}, src AS (SELECT doc_id, source AS file FROM documents),
v AS (SELECT file, count(DISTINCT term) AS vocabulary_size, sum(len(term) * tf) AS chars FROM post JOIN src USING (doc_id) GROUP BY file),
t AS (SELECT file, count(*) AS total_documents, CAST(sum(dl) AS BIGINT) AS total_tokens FROM dl JOIN src USING (doc_id) GROUP BY file)
SELECT '{name}' AS config, file, total_documents, total_tokens, coalesce(vocabulary_size, 0) AS vocabulary_size,
round(total_tokens / total_documents, 6) AS avg_document_length, round(CASE WHEN total_tokens > 0 THEN chars / total_tokens ELSE 0 END, 6) AS avg_term_length FROM t LEFT JOIN v USING (file))"""
        )
    return " UNION ALL ".join(parts)


_add(
    "experiment_matrix",
    lambda s, d: stats.experiment_matrix(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"), "source", list(CONFIGS.values())).select("config", "file", "total_documents", "total_tokens", "vocabulary_size", _r("avg_document_length"), _r("avg_term_length")),
    _experiment_sql(),
)

# Boolean retrieval ------------------------------------------------------------------------------

_B = f"WITH {sql.BASIC}, u AS (SELECT doc_id FROM documents), p AS (SELECT DISTINCT doc_id, term FROM basic)"


def _p(term: str) -> str:
    return f"SELECT doc_id FROM p WHERE term = '{term}'"


def _two(s: SparkSession, d: str):
    i = index.build_index(documents(s, d), BASIC)
    return i, index.postings_of(i, "thing"), index.postings_of(i, "under")


_add("bool_and", lambda s, d: boolean.intersection(*_two(s, d)[1:]), f"{_B} {_p('thing')} INTERSECT {_p('under')}")
_add("bool_or", lambda s, d: boolean.union(*_two(s, d)[1:]), f"{_B} {_p('thing')} UNION {_p('under')}")
_add("bool_not", lambda s, d: boolean.complement(_two(s, d)[0].docs, _two(s, d)[1]), f"{_B} SELECT doc_id FROM u EXCEPT {_p('thing')}")
_add("bool_and_not", lambda s, d: boolean.difference(*_two(s, d)[1:]), f"{_B} {_p('thing')} EXCEPT {_p('under')}")
for _name, _query, _sql in [
    ("bool_query_adjacent", "Thing under", f"{_p('thing')} INTERSECT {_p('under')}"),
    ("bool_query_mixed", "thing and the or under and not that", f"(({_p('thing')} INTERSECT {_p('the')}) UNION {_p('under')}) EXCEPT {_p('that')}"),
    ("bool_query_or_not", "the or not thing", f"{_p('the')} EXCEPT {_p('thing')}"),
    (
        "bool_empty_reset",
        "zzzz and thing and qqqq and under",
        f"SELECT doc_id FROM ({_p('under')}) WHERE (SELECT count(*) FROM ({_p('thing')} INTERSECT {_p('qqqq')})) = 0 UNION ALL ({_p('thing')} INTERSECT {_p('qqqq')} INTERSECT {_p('under')})",
    ),
]:
    _add(_name, lambda s, d, q=_query: boolean.evaluate(index.build_index(documents(s, d), BASIC), q), f"{_B} {_sql}")

# Weights and ranking ----------------------------------------------------------------------------


def _ranked_sql(config: str, scheme: str, k: int, extra: str = "") -> str:
    qt = _query_terms_sql(config).replace("WITH documents AS", "WITH topics AS", 1).replace("FROM documents)", "FROM topics)", 1)
    return f"""SELECT * FROM ({sql.weighted(config)}, q AS ({qt}),
r AS (SELECT query_id, doc_id, round(sum({scheme}), 6) AS score FROM w JOIN q USING (term) GROUP BY ALL),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT {extra}query_id, rank, doc_id, score FROM k WHERE rank <= {k})"""


for _scheme in weights.SCHEMES:
    _add(f"weights_{_scheme}", lambda s, d, x=_scheme: weights.weights(_built(s, d), x).select("term", "doc_id", _r("weight")), f"{sql.weighted()} SELECT term, doc_id, round({_scheme}, 6) AS weight FROM w")
    _add(
        f"topk_{_scheme}",
        lambda s, d, x=_scheme: rank.search(_built(s, d), QUERY, x),
        f"{sql.weighted()} SELECT doc_id, round(sum({_scheme}), 6) AS score FROM w WHERE term IN ({_words(QUERY.split())}) GROUP BY doc_id HAVING round(sum({_scheme}), 6) > 0 ORDER BY score DESC, doc_id LIMIT 10",
    )
_add("doc_norms", lambda s, d: weights.document_norms(_built(s, d)).select("doc_id", _r("norm")), f"{sql.weighted()} SELECT doc_id, round(norm, 6) AS norm FROM norms")
_add("term_weight", lambda s, d: weights.term_weight(_built(s, d), "thing", DOC, "ltc").select(_r("weight")), f"{sql.weighted()} SELECT coalesce(max(round(ltc, 6)), 0.0) AS weight FROM w WHERE term = 'thing' AND doc_id = {DOC}")
_add(
    "rsv_doc",
    lambda s, d: weights.rsv(_built(s, d), dict.fromkeys(QUERY.split(), 1.0), "bm25").select("doc_id", _r("score")),
    f"{sql.weighted()} SELECT doc_id, round(sum(bm25), 6) AS score FROM w WHERE term IN ({_words(QUERY.split())}) GROUP BY doc_id",
)
_add(
    "rsv_qvec",
    lambda s, d: weights.rsv(_built(s, d), QUERY_VECTOR, "ltc").select("doc_id", _r("score")),
    f"{sql.weighted()} SELECT doc_id, round(sum(ltc * CASE WHEN term IN ('the', 'ering') THEN 1.0 ELSE 0.0 END), 6) AS score FROM w WHERE term IN ({_words(TERMS)}) GROUP BY doc_id",
)


def _experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scheme, the weight of the query's second term in a document, that document's score, and the best document."""
    rows = None
    terms = rank.query_terms(QUERY, BASE)
    for scheme in weights.SCHEMES:
        i = _built(spark, sf_dir)
        weight = weights.term_weight(i, terms[1], DOC, scheme).select(F.round("weight", 6).alias("weight"))
        score = weights.rsv(i, dict.fromkeys(terms, 1.0), scheme).where(F.col("doc_id") == DOC).agg(F.coalesce(F.round(F.max("score"), 6), F.lit(0.0)).alias("rsv"))
        best = rank.search(i, QUERY, scheme, 1).agg(F.max("doc_id").alias("best_doc"), F.max("score").alias("best_score"))
        one = weight.join(score).join(best).select(F.lit(scheme).alias("scheme"), "weight", "rsv", "best_doc", "best_score")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _experiment_weighting_sql() -> str:
    terms = sorted(QUERY.split())
    parts = [
        f"""SELECT '{x}' AS scheme, coalesce((SELECT round({x}, 6) FROM w WHERE term = '{terms[1]}' AND doc_id = {DOC}), 0.0) AS weight,
coalesce((SELECT round(sum({x}), 6) FROM w WHERE term IN ({_words(terms)}) AND doc_id = {DOC}), 0.0) AS rsv, t{x}.doc_id AS best_doc, t{x}.score AS best_score FROM t{x}"""
        for x in weights.SCHEMES
    ]
    tops = ", ".join(f"t{x} AS (SELECT doc_id, round(sum({x}), 6) AS score FROM w WHERE term IN ({_words(terms)}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 1)" for x in weights.SCHEMES)
    return f"{sql.weighted()}, {tops} " + " UNION ALL ".join(parts)


_add("experiment_weighting", _experiment, _experiment_weighting_sql())
_add(
    "batch_runs",
    lambda s, d: rank.batch(documents(s, d), query_set(s, TOPICS), list(CONFIGS.values())),
    " UNION ALL ".join(_ranked_sql(c, x, 1500, f"'{c}' AS config, '{x}' AS scheme, ") for c in CONFIGS for x in weights.SCHEMES),
)
_add(
    "run_lines",
    lambda s, d: run_lines(rank.ranked(_built(s, d), query_set(s, TOPICS), "bm25"), TAG),
    f"SELECT query_id, rank, printf('%d Q0 %d %d %.6f {TAG} /article[1]', query_id, doc_id, rank, score) AS line FROM ({_ranked_sql('base', 'bm25', 1500)})",
)
_add(
    "jaccard_query_doc",
    lambda s, d: rank.jaccard_pairs(s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), documents(s, d)).select("query_id", "doc_id", _r("jaccard")),
    """WITH a AS (SELECT DISTINCT item_id AS query_id, lower(w) AS w FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)),
b AS (SELECT DISTINCT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)),
na AS (SELECT query_id, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY ALL),
k AS (SELECT query_id, doc_id, count(*) AS k FROM a JOIN b USING (w) GROUP BY ALL)
SELECT query_id, doc_id, round(k / (na.n + nb.n - k), 6) AS jaccard FROM k JOIN na USING (query_id) JOIN nb USING (doc_id)""",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
