import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.config import BASE, STEM, STOP, STOP_STEM, Analyzer
from textloom.functions.stopwords import default_stop_words
from textloom.operators import boolean, index, rank, stats, weights
from textloom.sources import collection, sinks

TITLES = ["Citizen Kane", "Casablanca", "The Godfather: The Godfather", "Gone with the Wind", "Lawrence of Arabia", "The Wizard of Oz, the wizard of Oz", "The Graduate", "On the Waterfront", "Schindler’s List", "Singin’ in the Rain"]


@pytest.fixture(scope="module")
def films(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("films") / "films.txt"
    path.write_text("\n".join(f"<doc><docno>D{k}</docno>{t}</doc>" for k, t in enumerate(TITLES)) + "\n", encoding="utf-8")
    docs = collection.read_tagged(spark, str(path), inner_tags=False)
    return index.build_index(docs.select("doc_id", "text"), Analyzer(tokenizer="basic"))


@pytest.mark.parametrize(
    "query,expected",
    [
        ("citizen and kane", "D0"),
        ("the or godfather", "D2 D3 D5 D6 D7 D9"),
        ("the and not godfather", "D3 D5 D6 D7 D9"),
        ("not citizen", "D1 D2 D3 D4 D5 D6 D7 D8 D9"),
        ("of and wizard", "D5"),
        ("lawrence or oz", "D4 D5"),
        ("citizen kane", "D0"),
        ("zzz and kane", "D0"),
        ("citizen and casablanca and the", "D2 D3 D5 D6 D7 D9"),
        ("the or not godfather", "D3 D5 D6 D7 D9"),
        ("", ""),
        ("not not x", ""),
        ("not not", "D0 D1 D2 D3 D4 D5 D6 D7 D8 D9"),
    ],
)
def test_boolean(films, query, expected):
    assert sorted(r.doc_id for r in boolean.evaluate(films, query).collect()) == expected.split()


def test_trailing_not_is_an_error():
    with pytest.raises(ValueError):
        boolean.parse("the not")


def test_set_operations(films):
    the, god = index.postings_of(films, "The"), index.postings_of(films, "godfather")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(boolean.intersection(the, god)) == ["D2"]
    assert ids(boolean.difference(the, god)) == ids(boolean.intersection(the, boolean.complement(films.docs, god)))
    # De Morgan
    assert ids(boolean.complement(films.docs, boolean.union(the, god))) == ids(boolean.intersection(boolean.complement(films.docs, the), boolean.complement(films.docs, god)))
    assert index.document_frequency(films, "nothing").first()[0] == 0
    assert index.postings_of(films, "nothing").count() == 0


def test_tagged_sources(spark, tmp_path):
    text = "<doc><docno> 1 </docno>\na <b>b</b>\n</doc>\n<doc><docno>2</docno></doc>\n<doc><docno>3</docno>c d</doc>\n"
    plain = tmp_path / "x.txt"
    plain.write_text(text)
    rows = [(r.doc_id, r.text) for r in collection.read_tagged(spark, str(plain)).orderBy("doc_pos").collect()]
    assert rows == [("1", "a <b>b</b>"), ("2", ""), ("3", "c d")]
    assert [(r.doc_id, r.text) for r in collection.read_tagged_split(spark, str(plain)).orderBy("doc_pos").collect()] == rows
    assert [r.doc_id for r in collection.read_tagged(spark, str(plain), inner_tags=False).collect()] == ["3"]
    import gzip

    for name in ("b.gz", "a.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text if name == "a.gz" else "<doc><docno>9</docno>z</doc>")
    assert [(r.label, r.path.rpartition("/")[2]) for r in collection.list_files(spark, str(tmp_path)).collect()] == [("file1", "a.gz"), ("file2", "b.gz")]
    series = collection.read_series(spark, str(tmp_path))
    assert {k: v.count() for k, v in series.items()} == {"file1": 3, "file2": 1}
    assert collection.list_files(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def letters(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choices("abcde", weights=[1, 2, 1, 3, 9], k=r.choice([0, 0, 0, 5, 20])))) for k in range(200)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows):
    tf = {d: {t: text.split().count(t) for t in set(text.split())} for d, text in rows}
    df = {}
    for v in tf.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    n, dl = len(rows), {d: len(text.split()) for d, text in rows}
    avg = sum(dl.values()) / n
    ltn = {d: {t: (1 + math.log10(f)) * (math.log10(n / df[t]) if n > df[t] else 0) for t, f in v.items()} for d, v in tf.items()}
    norm = {d: math.sqrt(sum(w * w for w in v.values())) or 1.0 for d, v in ltn.items()}
    bm = {d: {t: math.log10((n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl[d] / avg)) for t, f in v.items()} for d, v in tf.items()}
    return {"ltn": ltn, "ltc": {d: {t: w / norm[d] for t, w in v.items()} for d, v in ltn.items()}, "bm25": bm}, norm


@pytest.mark.parametrize("scheme", weights.SCHEMES)
def test_weights_and_ranking(letters, scheme):
    rows, docs = letters
    expected, norm = brute(rows)
    i = index.build_index(docs)
    got = {(r.doc_id, r.term): r.weight for r in weights.weights(i, scheme).collect()}
    assert got == pytest.approx({(d, t): w for d, v in expected[scheme].items() for t, w in v.items()})
    score = {d: round(sum(v.get(t, 0) for t in "ab"), 6) for d, v in expected[scheme].items()}
    best = sorted(((-s, d) for d, s in score.items() if s > 0))[:10]
    assert [(r.doc_id, r.score) for r in rank.search(i, "A b", scheme).collect()] == [(d, -s) for s, d in best]
    assert {r.doc_id: r.norm for r in weights.document_norms(i).collect()} == pytest.approx(norm)


def test_term_weight_edges(letters):
    _, docs = letters
    i = index.build_index(docs)
    assert weights.term_weight(i, "zzz", 1, "ltn").first()[0] == 0
    assert weights.term_weight(i, "a", -1, "bm25").first()[0] == 0
    assert weights.term_weight(i, "a", 1, "other").first()[0] == 0
    assert rank.search(i, "a b", "other").collect() == rank.search(i, "a b", "ltn").collect()
    with pytest.raises(IndexError):
        rank.weighting_experiment(i, "a", 1, "ltn")
    got = rank.weighting_experiment(i, "b a", 5, "ltn", 3)
    assert got["term"] == "b" and len(got["top"]) == 3


def test_golden_weights(spark):
    """Document 1 and 2 of a collection with N = 1000, df a 11, b 26, c 11, d 24, e 250, 20000 terms."""
    tf = {1: {"a": 1, "c": 1, "d": 4, "e": 5}, 2: {"a": 1, "b": 4, "c": 1}}
    df = {"a": 11, "b": 26, "c": 11, "d": 24, "e": 250}
    rows = [(d, t, f, df[t], 1000, sum(v.values()), 20.0) for d, v in tf.items() for t, f in v.items()]
    t = spark.createDataFrame(rows, "doc long, term string, tf long, df long, n long, dl long, avg double")
    got = {(r.doc, r.term): (round(r.l, 6), round(r.b, 6)) for r in t.select("doc", "term", weights.ltn(F.col("tf"), F.col("df"), F.col("n")).alias("l"), weights.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avg")).alias("b")).collect()}
    assert got[1, "a"] == (1.958607, 2.371242) and got[1, "d"] == (2.594999, 2.937321) and got[1, "e"] == (1.022882, 0.904568)
    assert got[2, "b"] == (2.539308, 3.01459899) or got[2, "b"] == (2.539308, 3.014599)


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "The cats, the Cat"), (2, ""), (3, None), (4, "running a b")], "doc_id long, text string")
    i = index.build_index(docs)
    row = stats.occurrence_statistics(i).first()
    assert (row.total_documents, row.total_tokens, row.vocabulary_size) == (4, 7, 6)
    assert row.avg_document_length == pytest.approx(7 / 4) and row.avg_term_length == pytest.approx((3 + 4 + 3 + 3 + 7 + 1 + 1) / 7)
    v = stats.vocabulary_statistics(docs, index.build_index(docs, STOP_STEM), 1.5).first()
    assert (v.total_tokens, v.distinct_tokens, v.total_terms, v.distinct_terms, v.indexing_time) == (7, 7, 4, 3, 1.5)
    empty = stats.occurrence_statistics(index.build_index(docs.limit(0))).first()
    assert list(empty) == [0.0, 0.0, 0, 0, 0]
    results = stats.experiment({"file1": docs, "file2": docs}, STEM, use_all_files=False)
    assert [r["file"] for r in results] == ["file2"] and stats.experiment({}, BASE) == []


def test_index_views(spark, letters):
    _, docs = letters
    i = index.build_index(docs)
    lengths = {r.doc_id: r.dl for r in i.docs.collect()}
    sums = {r.doc_id: r.s for r in i.postings.groupBy("doc_id").agg(F.sum("tf").alias("s")).collect()}
    assert {d: n for d, n in lengths.items() if n} == sums and len(lengths) == 200
    lists = {r.term: r.doc_ids for r in index.postings_lists(i).collect()}
    assert all(v == sorted(v) for v in lists.values())
    assert {r.term: len(r.postings) for r in index.dictionary(i).collect()} == {t: len(v) for t, v in lists.items()} == {r.term: r.df for r in i.terms.collect()}
    more = index.add_documents(i, spark.createDataFrame([(1000, "a zebra")], "doc_id long, text string"))
    assert more.scalars.first().doc_count == 201 and index.document_frequency(more, "zebra").first()[0] == 1
    assert index.build_index(docs, STOP).scalars.first().total_terms == sum(t.count("a") for _, t in letters[0])


def test_saved_index(spark, letters, tmp_path):
    built = index.build_index(letters[1])
    index.save_index(built, str(tmp_path / "index"), parts=8)
    loaded = index.load_index(spark, str(tmp_path / "index"), parts=8)
    for scheme in weights.SCHEMES:
        assert rank.search(loaded, "b c", scheme).collect() == rank.search(built, "b c", scheme).collect()
    assert sorted(map(tuple, loaded.postings.select("term", "doc_id", "tf").collect())) == sorted(map(tuple, built.postings.select("term", "doc_id", "tf").collect()))
    plan = loaded.postings_for(["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan or "PartitionFilters: [part" in plan


def test_plans(spark, letters, tmp_path):
    letters[1].write.parquet(str(tmp_path / "documents.parquet"))
    built = index.build_index(collection.documents(spark, str(tmp_path)))
    plan = rank.search(built, "a b", "ltn")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    # Terms are counted where the texts are read, and the scores of a kept index where its postings lie.
    assert "Exchange" not in built.postings._jdf.queryExecution().executedPlan().toString()
    kept = index.build_index(collection.documents(spark, str(tmp_path))).persist()
    for scheme in ("ltn", "bm25"):
        plan = rank.search(kept, "a b", scheme)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Join" not in plan.split("InMemoryRelation")[0], plan
        assert rank.search(kept, "a b", scheme).collect() == rank.search(built, "a b", scheme).collect()
    assert rank.search(kept, "a b", "ltc").collect() == rank.search(built, "a b", "ltc").collect()
    kept.release()


def test_golden_index(films):
    """Document frequencies and term frequencies of the ten titles; those not named are 1."""
    df = {r.term: r.df for r in films.terms.collect()}
    assert len(df) == 21 and (df["of"], df["the"]) == (2, 6) and {t for t, n in df.items() if n > 1} == {"of", "the"}
    tf = {(r.term, r.doc_id): r.tf for r in films.postings.collect()}
    assert {k: v for k, v in tf.items() if k[0] == "the"} == {("the", f"D{k}"): n for k, n in ((2, 2), (3, 1), (5, 2), (6, 1), (7, 1), (9, 1))}
    more = {("godfather", "D2"): 2, ("of", "D4"): 1, ("of", "D5"): 2, ("oz", "D5"): 2, ("wizard", "D5"): 2, ("schindler", "D8"): 1, ("list", "D8"): 1, ("singin", "D9"): 1}
    assert more.items() <= tf.items()
    lines = {(r.term, r.line_no): r.line for r in index.dump(films, with_tf=True).collect()}
    assert lines["the", 0] == "6=df(the)" and lines["the", 1] == "    2 D2" and lines["the", 6] == "    1 D9"


def test_golden_weights_end_to_end(spark):
    """1000 documents, 20000 terms, df a 11, b 26, c 11, d 24, e 250, from text to norms, weights and scores."""
    texts = {1: "a c " + "d " * 4 + "e " * 5, 2: "a " + "b " * 4 + "c"} | dict.fromkeys(range(3, 1001), "")
    for term, df in (("a", 11), ("b", 26), ("c", 11), ("d", 24), ("e", 250)):
        more = df - sum(term in texts[k].split() for k in (1, 2))
        for k in range(3, 3 + more):
            texts[k] += f" {term}"
    texts[3] += " e" * (20000 - sum(len(t.split()) for t in texts.values()))
    built = index.build_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).persist()
    row = built.scalars.first()
    assert (row.doc_count, row.total_terms, row.avg_doc_length) == (1000, 20000, 20.0)
    assert {r.term: r.df for r in built.terms.collect()} == {"a": 11, "b": 26, "c": 11, "d": 24, "e": 250}
    norms = {r.doc_id: round(r.norm, 6) for r in weights.document_norms(built).where("doc_id < 3").collect()}
    assert norms == {1: 3.930978, 2: 3.757708}
    expected = {
        "ltn": ({"a": 1.958607, "c": 1.958607, "d": 2.594999, "e": 1.022882}, {"a": 1.958607, "b": 2.539308, "c": 1.958607}, (2.981489, 1.958607)),
        "ltc": ({"a": 0.498249, "c": 0.498249, "d": 0.660141, "e": 0.260211}, {"a": 0.521224, "b": 0.675760, "c": 0.521224}, (0.758460, 0.521224)),
        "bm25": ({"a": 2.371242, "c": 2.371242, "d": 2.937321, "e": 0.904568}, {"a": 2.711070, "b": 3.014599, "c": 2.711070}, (3.275810, 2.711070)),
    }
    for scheme, (one, two, scores) in expected.items():
        got = {(r.doc_id, r.term): r.weight for r in weights.weights(built, scheme).where("doc_id < 3").collect()}
        assert got == pytest.approx({(1, t): w for t, w in one.items()} | {(2, t): w for t, w in two.items()}, abs=2e-6)
        found = {r.doc_id: r.score for r in weights.rsv(built, {"a": 1, "b": 0, "c": 0, "d": 0, "e": 1}, scheme).where("doc_id < 3").collect()}
        assert (found[1], found[2]) == pytest.approx(scores, abs=2e-6)
    built.release()


def test_golden_jaccard(spark):
    queries = spark.createDataFrame([(1, "information on cars"), (2, "information on cars"), (3, "red cars and trucks")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "all you’ve ever wanted to know about cars"), (2, "information on trucks, information on planes, information on trains"), (3, "cops stop red cars more often"), (4, None)], "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.jaccard for r in rank.jaccard_pairs(queries, docs).collect()}
    assert (got[1, 1], got[2, 2], got[3, 3]) == pytest.approx((1 / 11, 2 / 6, 2 / 8)) and not any(d == 4 for _, d in got)
    high = {(r.query_id, r.doc_id): r.jaccard for r in rank.jaccard_pairs(queries, docs, least=0.25).collect()}
    assert high == {k: v for k, v in got.items() if v >= 0.25}


def test_trace(films):
    trace = lambda q: sorted((r.part, r.doc_id) for r in boolean.explain_query(films, q).collect())
    assert trace("of and wizard") == [("of", "D4"), ("of", "D5"), ("result", "D5"), ("wizard", "D5")]
    universe = [f"D{k}" for k in range(10)]
    assert trace("not citizen") == [("citizen", "D0"), *(("result", d) for d in universe[1:]), *(("universe", d) for d in universe)]
    assert trace("") == []


def test_boolean_is_one_job(spark, films):
    plan = boolean.evaluate(films, "the or godfather and not oz")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan  # nothing was decided on the driver


def test_porter_in_sql(spark):
    from textloom.functions.stem import register

    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT porter_stem('scoring') AS a, porter_stem('ranking') AS b, porter_stem(NULL) AS c").collect()] == [("score", "rank", None)]


def test_charts_and_synthesis(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    files = {"file1": docs.limit(1), "file2": docs}
    results = stats.experiment(files, BASE)
    assert sinks.chart_single(results, "vocabulary_size") == [("file1", 2), ("file2", 3)]
    assert sinks.chart_single(results, "total_tokens") == [("file1", 2), ("file2", 3)]
    rows = stats.synthesis(spark, {"base": results, "stop": []}).collect()
    assert [(r.config, r.file, r.avg_document_length, r.vocabulary_size) for r in rows] == [("base", "file2", 1.5, 3)]
    assert rows[0].avg_term_length == pytest.approx(11 / 3) and rows[0].time_seconds > 0


def test_frequencies_of_odd_texts(spark):
    texts = [None, "", "...", "Aa aA\u212a b\u0130c", "x" * 3000, "word " * 70_000, "é", "a1b2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import re
    from collections import Counter

    expected = {(t, k): n for k, x in enumerate(texts) for t, n in Counter(w.lower() for w in re.findall("[A-Za-z]+", x or "")).items()}
    i = index.build_index(docs)
    assert {(r.term, r.doc_id): r.tf for r in i.postings.collect()} == expected
    assert {r.doc_id: r.dl for r in i.docs.collect()} == {k: sum(n for (_, d), n in expected.items() if d == k) for k in range(len(texts))}
    rows = index.occurrences(docs, BASE).groupBy("term", "doc_id").count().collect()
    assert {(r.term, r.doc_id): r["count"] for r in rows} == expected
    assert index.build_index(docs.limit(0), STOP_STEM).postings.collect() == []


def test_runs(spark, letters, tmp_path):
    _, docs = letters
    queries = collection.query_set(spark, {2: "a b", 1: "c"})
    ranking = rank.ranked(index.build_index(docs), queries, "bm25", 5)
    rows = ranking.orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"]) for r in rows] == [(q, k) for q in (1, 2) for k in range(1, 6)]
    (tmp_path / "runs").mkdir()
    assert sinks.next_run_id(spark, str(tmp_path / "runs")) == 0
    name = sinks.run_name(3, "team", "bm25", STOP_STEM)
    assert name == f"team_3_test_bm25_article_stop{len(default_stop_words())}_porter_k1.2_b0.75.txt"
    assert "_stop2_" in sinks.run_name(3, "team", "ltn", Analyzer(stop=True, words=("x", "y"))) and "_stop671_" in sinks.run_name(3, "team", "ltn", STOP, n_stop=671) and sinks.run_name(3, "team", "ltn", BASE).endswith("ltn_article_nostop_nostem.txt")
    for _ in range(2):
        sinks.write_run(ranking, str(tmp_path / "runs" / name), "team")
    lines = [r.value for r in spark.read.text(str(tmp_path / "runs" / name)).collect()]
    assert len(lines) == 10 and lines[0] == f"1 Q0 {rows[0].doc_id} 1 {rows[0].score:.6f} team /article[1]"
    batch = rank.batch(docs, queries, [BASE, STEM], ("ltn", "bm25"), 3)
    assert batch.select("config", "scheme", "query_id").distinct().count() == 8


def test_norm_cache_and_charts(spark, letters, tmp_path):
    i = index.build_index(letters[1])
    cache = sinks.NormCache(spark, str(tmp_path), "letters", BASE)
    assert cache.load(i).count() == 200 == cache.load(i).count()
    assert sinks.NormCache(spark, str(tmp_path), "others", BASE).path != cache.path
    cache.clear()
    assert not list(tmp_path.iterdir())
    chart = sinks.chart_comparison(spark, {"all": [1, 2], "last": [5], "odd": [1, 2, 3]}, ["f1", "f2"])
    assert sorted(map(tuple, chart.collect())) == [("all", "f1", 1.0), ("all", "f2", 2.0), ("last", "f2", 5.0)]


def test_stream(spark, tmp_path):
    from textloom.streaming.postings import stream_postings

    spark.createDataFrame([(1, "a a b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = stream_postings(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == [("a", 1, 2), ("b", 1, 1)]
    with pytest.raises(ValueError):
        stream_postings(stream, STEM)


def test_batch_equals_single_rankings_with_rare_terms_apart(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("walk", "running", "relat", "the", "being", "hop") for b in ("", "s", "ed", "ing", "ational")]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 9)))) for k in range(60)] + [(60, None), (61, "been unseen")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), collection.query_set(spark, {1: "walking relational", 2: "the hopped being", 3: "absent"})
    got = rank._shared_batch(docs, queries, [BASE, STOP_STEM], rank.SCHEMES, 20, often=7).collect()
    for config in (BASE, STOP_STEM):
        one = rank.ranked_by_scheme(index.build_index(docs, config), queries, k=20).collect()
        assert sorted(r[1:] for r in got if r[0] == config.name) == sorted(map(tuple, one)) != []


def test_batch_does_not_move_postings(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(r.sample(words, 1500))) for k in range(300)], "doc_id long, text string").repartition(4).persist()
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert rank.batch(docs, collection.query_set(spark, {1: f"{words[0]} {words[1]}"}), [BASE, STOP, STEM, STOP_STEM], k=10).count() == 120
    assert written() - before < size / 2
