import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftwork.llm.langid import identify
from weftwork.llm.mixing import mix
from weftwork.llm.tokens import public_file

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = sorted(r.doc_id for r in identify(docs).collect() if r.kept)
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    from tests.llm.test_pairs import brute

    same = brute([(i, rows[i].text) for i in left], 5, 4, 5)
    left = [i for i in left if same[i][1] == i]
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(words(r.text)) >= 13]
    left = [i for i in left if not any(f" {t} " in f" {' '.join(words(rows[i].text))} " for t in items)]
    got = {name: None for name, _ in corpus_pipeline.STAGES}
    d = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = spark.createDataFrame(stage(spark, d, DATA).collect(), docs.schema)
        got[name] = d
    assert sorted(r.doc_id for r in d.collect()) == left and d.columns == docs.columns
    mixed = corpus_pipeline.mixed(spark, d, DATA)
    times = {r.doc_id: r.taken // r.size for r in mix(d).collect() if r.taken}
    want = sorted(i for i, n in times.items() for _ in range(n))
    assert len(set(want)) > len(left) / 2 and len(want) > len(set(want))
    assert sorted(r.doc_id for r in mixed.collect()) == want and mixed.columns == docs.columns
    out = sorted(corpus_pipeline.run(spark, DATA).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == want
    tok, at = Tokenizer.from_file(public_file("byte_bpe_50k.json")), 0
    for r in out:
        ids = np.array([*tok.encode(rows[r.doc_id].text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stages_on_odd_rows(spark):
    text = "the cat and the dog sat on the mat with that old hat of this and the bird " * 3
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text, "en", "a", 9), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "of the and that with this from " * 9, "en", None, 1), (5, "la casa de los que por una " * 2000, "es", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS times", "2 AS copy", "3 AS row", "4 AS named", "5 AS kept", "6 AS component_id", "'x' AS host")
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=str)
    want = {"language_id": [1, 1, 2, 5, None], "near_duplicates": [1, 1, 3, 4, 5, None], "decontamination": [1, 1, 2, 3, 4, 5, None]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "token_output":
            assert out.columns == docs.columns
        if name in want:
            assert ids(out) == want[name], name
        elif name == "source_mix":
            times = {}
            for r in mix(docs).collect():
                times.setdefault(r.doc_id, []).append(r.taken // r.size if r.size else 0)
            assert sorted(map(str, ids(out))) == sorted(str(i) for i, x in times.items() for n in x for _ in range(n)) and None in ids(out)
        else:
            assert out.count() == len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    bad = spark.createDataFrame([(None, item, "en", "a", 1), (7, f"x {item} y", "en", "a", 1), (8, "clean", "en", "a", 1)], docs.select(*docs.columns[:5]).schema)
    assert ids(corpus_pipeline.decontaminated(spark, bad, DATA)) == [8]
