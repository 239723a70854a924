import corpus_pipeline
import __spark_entry__
from loadspan.llm import quality, queries, simhash, toxicity
from tests.llm.conftest import SF


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_stages_take_effect(spark):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:])) and 0 < len(kept[-1]) < before.count()
    model = toxicity.fit(before.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    fine = toxicity.scored(before, model).where("score < 0.5")
    assert {r.doc_id for r in fine.collect()} == kept[0]
    assert {r.doc_id for r in quality.judged(fine.drop("score", "toxic_spans")).where("kept").collect()} == kept[1]
    left = [r.fingerprint for r in simhash.fingerprints(docs).collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(left) for b in left[:i])
    packed = corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()
    assert {r.doc_id for r in packed} == kept[-1]


def test_stages_clear_up_but_keep_what_is_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lazy = corpus_pipeline.good_quality(spark, docs, SF)
    again = corpus_pipeline.good_quality(spark, lazy, SF)  # reads the tables of the first call
    assert 0 < again.count() <= lazy.count()
    before = list(corpus_pipeline._left)
    corpus_pipeline.not_toxic(spark, docs, SF)
    assert before and not set(before) & set(corpus_pipeline._left)


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and no rows at all."""
    good = " ".join(f"word{i} of a plain sentence that stands by itself number {i}." for i in range(40))
    rows = [
        (1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, None, None, None, None), (3, "", "en", None, 0), (None, good + " without a key", "en", "b", 1),
        (4, "\n".join(f"{i} {good}" for i in range(200)), "en", "b", None), (5, " \n\t ", None, "c", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF).collect()
            if name != "best-fit packing":
                assert not out or out[0].__fields__ == corpus_pipeline.COLUMNS
                assert {r.doc_id for r in out} <= {1, 2, 3, 4, 5, None}
            else:
                assert {r.doc_id for r in out} == ({1, 2, 3, 4, 5, None} if docs is df else set()) and len([r for r in out if r.doc_id == 1 and r.piece == 0]) == (2 if docs is df else 0)
        assert docs is not df or {r.doc_id for r in corpus_pipeline.not_toxic(spark, df, SF).collect()} == {1, 2, 3, 4, 5, None}
        assert docs is not df or {r.doc_id for r in corpus_pipeline.fresh_lines(spark, df, SF).collect()} >= {None, 2, 3, 5}  # the null key is the first
