"""DuckDB SQL for the registered retrieval queries, put together from common table expressions."""

from __future__ import annotations

from ..functions.stem import STEP_2, STEP_3, STEP_4
from ..functions.stopwords import default_stop_words

TOKENS = "tok AS (SELECT doc_id, t AS token, lower(t) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS t FROM documents))"
_STOPS = ", ".join(f"('{w}')" for w in default_stop_words())
OCC = {
    "base": f"{TOKENS}, occ AS (SELECT doc_id, term FROM tok)",
    "stop": f"{TOKENS}, occ AS (SELECT doc_id, term FROM tok WHERE term NOT IN (SELECT w FROM (VALUES {_STOPS}) s(w)))",
}


def shape(x: str) -> str:
    """The word's shape, 1 for vowels and 0 for consonants; runs of y up to eight letters."""
    form = f"regexp_replace(regexp_replace(regexp_replace({x}, '[aeiou]', '1', 'g'), '[^1y]', '0', 'g'), '^y', '0')"
    for _ in range(8):
        form = f"replace(replace({form}, '0y', '01'), '1y', '10')"
    return form


_M0, _M1 = "regexp_matches(s, '10')", "regexp_matches(s, '10.*10')"
_SHORT = "(s LIKE '%010' AND right(x, 1) NOT IN ('w', 'x', 'y'))"


def _suffix(rules) -> str:
    return "CASE " + " ".join(f"WHEN w LIKE '%{k}' THEN '{k}'" for k in sorted(rules, key=len, reverse=True)) + " ELSE '' END"


def _map(rules: dict[str, str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items()) + " END"


def _cut(name: str, source: str, suffix: str) -> str:
    """name: word, w, the found suffix e, the stem x before it, and the stem's shape s."""
    return f"{name} AS (SELECT *, {shape('x')} AS s FROM (SELECT *, left(w, len(w) - len(e)) AS x FROM (SELECT term, w, {suffix} AS e FROM {source})))"


def stems(source: str = "(SELECT DISTINCT term FROM occ)") -> str:
    """stems(term, stem) for the terms of a source."""
    undouble = "CASE WHEN x LIKE '%at' OR x LIKE '%bl' OR x LIKE '%iz' THEN x || 'e' WHEN len(x) > 1 AND right(x, 1) = substr(x, len(x) - 1, 1) AND s LIKE '%0' THEN CASE WHEN right(x, 1) IN ('l', 's', 'z') THEN x ELSE left(x, len(x) - 1) END"
    return ", ".join(
        [
            f"a1 AS (SELECT term, CASE WHEN term LIKE '%sses' OR term LIKE '%ies' THEN left(term, len(term) - 2) WHEN term LIKE '%s' AND term NOT LIKE '%ss' THEN left(term, len(term) - 1) ELSE term END AS w FROM {source} WHERE len(term) > 2)",
            _cut("a2", "a1", "CASE WHEN w LIKE '%eed' THEN 'eed' WHEN w LIKE '%ed' THEN 'ed' WHEN w LIKE '%ing' THEN 'ing' ELSE '' END"),
            f"a3 AS (SELECT term, CASE WHEN e = '' THEN w WHEN e = 'eed' THEN CASE WHEN {_M0} THEN left(w, len(w) - 1) ELSE w END WHEN s NOT LIKE '%1%' THEN w ELSE {undouble} WHEN {_M0} AND NOT {_M1} AND {_SHORT} THEN x || 'e' ELSE x END END AS w FROM a2)",
            _cut("a4", "a3", "CASE WHEN w LIKE '%y' THEN 'y' ELSE '' END"),
            "a5 AS (SELECT term, CASE WHEN e = 'y' AND s LIKE '%1%' THEN x || 'i' ELSE w END AS w FROM a4)",
            _cut("a6", "a5", _suffix(STEP_2)),
            f"a7 AS (SELECT term, CASE WHEN e <> '' AND {_M0} THEN x || {_map(STEP_2)} ELSE w END AS w FROM a6)",
            _cut("a8", "a7", _suffix(STEP_3)),
            f"a9 AS (SELECT term, CASE WHEN e <> '' AND {_M0} THEN x || {_map(STEP_3)} ELSE w END AS w FROM a8)",
            _cut("b1", "a9", _suffix(STEP_4)),
            f"b2 AS (SELECT term, CASE WHEN e = '' OR NOT {_M1} OR (e = 'ion' AND right(x, 1) NOT IN ('s', 't')) THEN w ELSE x END AS w FROM b1)",
            _cut("b3", "b2", "CASE WHEN w LIKE '%e' THEN 'e' ELSE '' END"),
            f"b4 AS (SELECT term, CASE WHEN e = 'e' AND ({_M1} OR ({_M0} AND NOT {_SHORT})) THEN x ELSE w END AS w FROM b3)",
            f"b5 AS (SELECT term, w, {shape('w')} AS s FROM b4)",
            f"stems AS (SELECT term, CASE WHEN w LIKE '%ll' AND {_M1} THEN left(w, len(w) - 1) ELSE w END AS stem FROM b5 UNION ALL SELECT term, term FROM {source} WHERE len(term) <= 2)",
        ]
    )


for _name, _base in (("stem", "base"), ("stopstem", "stop")):
    OCC[_name] = f"{OCC[_base]}, {stems()}, occ2 AS (SELECT doc_id, stem AS term FROM occ JOIN stems USING (term))"


def index(config: str = "base") -> str:
    """WITH ... post(term, doc_id, tf), df(term, df), dl(doc_id, dl), n (doc_count, total_terms, avg_doc_length)."""
    occ = "occ2" if "stem" in config else "occ"
    return f"""WITH {OCC[config]}, post AS (SELECT term, doc_id, count(*) AS tf FROM {occ} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
dl AS (SELECT d.doc_id, coalesce(k, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS k FROM {occ} GROUP BY doc_id) USING (doc_id)),
n AS (SELECT count(*) AS doc_count, CAST(sum(dl) AS BIGINT) AS total_terms, CASE WHEN count(*) > 0 THEN sum(dl) / count(*) ELSE 0.0 END AS avg_doc_length FROM dl)"""


LTN = "(1 + log10(tf)) * CASE WHEN doc_count > df THEN log10(doc_count / df) ELSE 0.0 END"
BM25 = "log10((doc_count - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_doc_length))"


def weighted(config: str = "base") -> str:
    """As index, then norms(doc_id, norm) and w(term, doc_id, ltn, ltc, bm25)."""
    return f"""{index(config)},
l AS (SELECT term, doc_id, tf, df, {LTN} AS ltn, {BM25} AS bm25 FROM post JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN n),
norms AS (SELECT doc_id, CASE WHEN q > 0 THEN sqrt(q) ELSE 1.0 END AS norm FROM dl LEFT JOIN (SELECT doc_id, sum(ltn * ltn) AS q FROM l GROUP BY doc_id) USING (doc_id)),
w AS (SELECT l.term, l.doc_id, ltn, ltn / norm AS ltc, bm25 FROM l JOIN norms USING (doc_id))"""


BASIC = r"""basic AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(regexp_replace(replace(lower(coalesce(text, '')), '’', ''''), '''s?\b', '', 'g'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL)"""
