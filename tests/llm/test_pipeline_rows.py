"""The pipeline's stages on odd rows: null and repeated ids, empty texts, further columns, empty tables."""

import corpus_pipeline
from tests.llm.test_operators import MIDDLE, quality, toxicity

GOOD = "This is a plain line of prose that says something and ends.\nAnother one follows it, with more to say about things."
BAD = "Home | About | Contact | More | Legal | Jobs\nHome | News | Contact | More | Legal | Jobs"
ROWS = [(1, GOOD, "a"), (2, GOOD + " Once more.", "b"), (2, BAD, "c"), (None, BAD, "d"), (None, GOOD + " And again it ends.", "e"), (3, None, "f"), (4, "", "g"), (5, GOOD + "\nAccept all cookies", "h")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), x) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")


def test_quality_goes_by_row(spark):
    found = corpus_pipeline.drop_low_quality(spark, frame(spark), MIDDLE)
    assert found.columns == frame(spark).columns
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {"a", "b", "e", "h"}
    assert rows["h"].text == GOOD and rows["h"].n_chars == len(GOOD) and rows["h"].doc_id == 5
    assert corpus_pipeline.drop_low_quality(spark, frame(spark).filter("false"), MIDDLE).count() == 0


def test_toxicity_goes_by_row(spark):
    bad = "You are an idiot, you moron, you worthless scum. You are trash and you are stupid."
    rows = [(1, GOOD, "a"), (1, bad, "b"), (None, bad, "c"), (None, GOOD, "d"), (2, None, "e"), (3, bad, "f"), (3, bad, "g")]
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")  # none that counts: the fixed grammar judges
    found = toxicity.keep_clean(frame(spark, rows), labels)
    assert found.columns == frame(spark).columns
    assert sorted(r.id for r in found.collect()) == ["a", "d", "e"]
    assert toxicity.keep_clean(frame(spark).filter("false"), labels).count() == 0


def test_all_stages_on_odd_rows(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, MIDDLE)
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} <= {1, 2, 5, None} and all(r.length > 0 for r in pieces)


def test_quality_keeps_what_the_rules_keep(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    verdicts = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    found = quality.keep_good(docs).collect()
    assert {r.doc_id for r in found} == {i for i, r in verdicts.items() if r.kept}
    assert all(r.text == verdicts[r.doc_id].clean_text for r in found)
