import random

import pytest
from brute import vocabulary


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): plain texts, exact copies, a crowd of edited copies, shared passages, junk and edge cases."""
    r = random.Random(7)
    vocab = vocabulary(1)
    text = lambda n: "".join(w + r.choice([" ", " ", " ", " ", "\n", ". ", "  "]) for w in r.choices(vocab, k=n))
    out = [text(r.randint(5, 300)) for _ in range(60)]
    base = text(140).split()
    for _ in range(60):  # edits from a few to far below the threshold
        w = list(base)
        for k in r.sample(range(len(w)), r.randint(0, 14)):
            w[k] = r.choice(vocab)
        out.append(" ".join(w))
    out += [out[3], out[3], out[5], out[5].upper()]
    passage = " ".join(r.choices(vocab, k=70))
    out += [f"{text(r.randint(0, 60))} {passage}\n{text(r.randint(1, 40))}" for _ in range(12)]
    out += [f"{text(30)} {' '.join(passage.split()[:48])} {text(30)}" for _ in range(3)]
    out += [passage, f"{passage} {passage}", "x", "", " \n\t ", None, "a b", "A B", "a  b\n", "é", "#*$ | " * 80, "same line\n" * 60, "LOUD WORDS " * 40, "word " * 20_000, "one two three four"]
    out += [text(6000)]
    rows = [(k * 3, t, r.choice(["en", "fr", None]), r.choice(["src0"] * 5 + ["src1", "src2", "src7", None])) for k, t in enumerate(out)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, and columns whose names the operators use themselves."""
    rows = [(None, None, None, None, 1, "x"), (None, "a b c", "en", "s1", 2, "y"), (1, None, None, "s1", 3, None), (2, "a b c", None, None, None, "z"), (2, "a b c", None, None, None, "z"), (2, "", "fr", "s2", 5, "w")]
    schema = "doc_id long, text string, lang string, source string, n long, key string"
    return spark.createDataFrame(rows, schema).withColumnsRenamed({"n": "n_words", "key": "row"})


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with further columns, named as the operators' own helpers are."""
    from pyspark.sql import functions as F

    names = ["measures", "rule_measure_n_words", "fail_bits", "gone_id", "gone", "key", "at", "cid", "spans", "cut_spans_", "cuts", "doc", "tokens_taken", "tokens_taken_", "n_tokens", "n_tokens_", "text_", "row", "domain", "whole_", "rest_", "range_", "edge_", "epoch", "group_", "shard", "slot", "lines", "digest", "form_digest", "length", "size", "kept", "score", "lang_pred"]
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
