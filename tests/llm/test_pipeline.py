import os

import pytest
from brute import kept_by_rules, mixed, near_components, pieces, without_repeats, words

import corpus_pipeline
from textloom.llm import tokens

SF = "/root/testdata/sf0.001"


def prefix(text, n):
    import re

    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return text if n >= len(ends) else text[: ends[n - 1]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if kept_by_rules(r[1])]
    roots, _ = near_components([r[:2] for r in rows], 5)
    rows = [r for r in rows if roots[r[0]] == r[0]]
    left = dict(without_repeats([r[:2] for r in rows]))
    rows = [(r[0], left[r[0]], *r[2:]) for r in rows if r[0] in left]
    mix = corpus_pipeline.MIX
    chosen = mixed(rows, lambda d: (f"d{int(d[3][3:]) % 4}", d[2], d[3]), lambda level, n: mix.weights.get(("domain", "lang", "source")[level], {}).get(n, 1), mix.share, mix.max_epochs, mix.seed)
    tool = Tokenizer.from_file(tokens.default_tokenizer())
    tool.encode_special_tokens = True
    expected = sorted((d[0], *p) for d, _, n in chosen for p in pieces(prefix(d[1], n) if n < len(words(d[1])) else d[1], tool))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_and_empty_tables(spark, odd, docs, clashing, tmp_path):
    """The stages run on an odd table (too short for the quality rules), an empty one, and one with clashing names."""
    for name, table in (("odd", odd), ("empty", docs.limit(0)), ("plain", docs), ("clashing", clashing)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").collect() == [] == corpus_pipeline.run(spark, f"{tmp_path}/empty").collect()
    plain, more = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()) for name in ("plain", "clashing"))
    assert plain == more and plain
