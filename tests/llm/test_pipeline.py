import re

import corpus_pipeline
from buslens.llm.registered import ORACLES, QUERIES


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {q.partition("_")[0] for q in QUERIES if q != "pipeline"}
    assert "pipeline" in QUERIES and "pipeline" not in ORACLES
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mix", "pack"]


def test_documents_in_several_languages_stay(spark):
    texts = {
        "en": "the house and the tree that is there with this thing of his from what they have seen",
        "fr": "le maison et les arbres qui sont avec cette chose de son père que nous avons été là",
        "de": "das haus und der baum ist nicht mit diesem ding von ihm was wir schon gesehen haben hier",
    }
    data = [(3 * i + k, " ".join(t.split()[i % 5:] * 3), lang, "s", 0) for i in range(40) for k, (lang, t) in enumerate(texts.items())]
    mixed = [(1000 + n, " ".join(" ".join((t.split() * 3)[:m]) for t, m in zip(texts.values(), shares)), None, "s", 0) for n, shares in enumerate(((20, 17, 13), (16, 16, 0), (18, 16, 16)))]
    bad = [(2000, "123 456", None, "s", 0), (2001, None, None, "s", 0), (2002, "", None, "s", 0)]
    docs = spark.createDataFrame(data + mixed + bad, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == sorted(r[0] for r in data + mixed)


def test_stages(spark, tmp_path):
    """Each stage on what the one before kept; the operators' own tests compare them with brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "pack":
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        kept.append(docs)
        docs = spark.read.parquet(str(tmp_path / name))
    raw, named, lines, single, mixed = kept
    bad = raw.count() - named.count()
    assert 0 <= bad <= 0.05 * raw.count()
    assert lines.count() == named.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    ids = [r.doc_id for r in single.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in lines.collect()}
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert abs(words(mixed.collect()) - 1.5 * words(single.collect())) <= 30
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in mixed.collect()}
