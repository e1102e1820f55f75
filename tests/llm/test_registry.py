import duckdb
import pytest

import corpus_pipeline
from cytofabric.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_their_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda d: sorted(tuple(map(str, r)) for r in d[columns].itertuples(index=False))
    assert as_rows(got) == as_rows(want)


def test_queries_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_pipeline_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_fm", "exact_dedup", "partenum_join", "pfair_mix", "piece_bpe"]
    good = stages["quality_fm"](spark, docs, SF)
    once = stages["exact_dedup"](spark, good, SF)
    kept = {}
    for r in good.collect():
        kept[r.text] = max(kept.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(kept.values())
    assert once.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) <= len(kept) and {r.doc_id for r in out} <= set(before)


def test_pipeline_is_brute_force(spark):
    """The whole result of run(), from the classifier's verdicts on, against plain Python and the tokenizer library."""
    import hashlib

    import sentencepiece

    from cytofabric.llm import piece_bpe, quality_fm

    from .test_operators import naive_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_fm.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.3").collect()}
    last = {}
    for r in docs.collect():
        if r.doc_id in good:
            last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    texts = {i: t for t, i in last.items()}
    components = naive_components(texts, 5, 80)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, (_, component) in components.items():
        if component == i:
            ids = library.encode(texts[i])
            want.add((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == want and len(out) == len(want) < len(texts)
    assert len({r.position for r in out}) == len(out)
