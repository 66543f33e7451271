"""The stages on the smallest tables, each against what it must have done to its input."""

import corpus_pipeline as cp
from chronotext.llm import decontamination as dc
from chronotext.llm import pieces as pc
from chronotext.llm import toxicity as tx

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    before = docs
    kept = []
    for name, stage in cp.STAGES[:-1]:
        after = cp.cut(stage(spark, before, SF))
        assert sorted(after.columns) == sorted(docs.columns)
        kept.append({r.doc_id: r.text for r in after.collect()})
        if name == "toxicity":
            model = tx.fit_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(kept[-1]) == {r.doc_id for r in before.collect() if model.score(r.text) < 0.5}
        if name == "decontamination":
            leaks = {r.doc_id for r in dc.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(kept[-1]) == set(kept[-2]) - leaks
        before = after
    assert len(set(kept[1].values())) == len(kept[1])
    out = cp.encoding(spark, before, SF).collect()
    codec = pc.PieceCodec(cp.PIECES)
    assert {r.doc_id: codec.decode(bytes(r.ids)) for r in out} == kept[-1]


def test_near_duplicates_by_row(spark):
    """Null and repeated ids: one row of each group stays, and no row goes for another that shares its id."""
    text = lambda k, last="end": " ".join(f"w{k}x{i}" for i in range(60)) + " " + last
    rows = [(None, text(1)), (5, text(1, "near")), (6, text(1)), (None, text(1)), (7, text(2)), (7, text(2)), (8, text(3)), (9, text(3)), (9, text(4)), (None, text(5)), (None, text(6)), (10, None), (10, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()]
    want = [(None, text(1)), (7, text(2)), (8, text(3)), (9, text(4)), (None, text(5)), (None, text(6)), (10, None), (10, None), (None, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_near_duplicates_keep_columns(spark):
    """Columns with the names that the stage would use come back as they were."""
    rows = [(1, "a b c d e f g", 77, "x"), (2, "a b c d e f g", 88, "y"), (3, "other words of a text here", 99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_no long, row_no_ string")
    assert sorted(map(tuple, cp.near_duplicates(spark, docs, SF).collect())) == [rows[0], rows[2]]
    assert cp.near_duplicates(spark, docs.limit(0), SF).count() == 0
