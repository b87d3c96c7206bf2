"""Each stage of the pipeline against a plain version on its own input."""

import corpus_pipeline
from recallspark.llm import pipeline
from recallspark.llm.common import materialize
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    states = [materialize(docs.select(*corpus_pipeline.COLUMNS))]
    for _, stage in corpus_pipeline.STAGES:
        states.append(materialize(stage(spark, states[-1], SF)))
    before, known, lines, groups, spans = ({r.doc_id: r.text for r in s.collect()} for s in states[:5])
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in states[:5])
    assert known.items() <= before.items() and len(known) > 0.9 * sum(any(c.isalpha() for c in t or "") for t in before.values())
    assert set(lines) == set(known) and all(len(lines[d]) <= len(known[d]) for d in lines)
    assert groups.items() <= lines.items()
    assert {d: brute.sha(t) for d, t in spans.items()} == {d: x[2] for d, x in brute.substring_dedup(groups).items()}
    packed = states[5].collect()
    assert {r.doc_id for r in packed} == set(spans)
    for s in states[:5]:
        assert all(r.n_chars == len(r.text) for r in s.collect())


def test_run_equals_stages_and_takes_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_with_repeated_shared_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}w{n}" for n in range(30))
    rows = [(1, text("a")), (1, text("a")), (2, text("a")), (None, text("a")), (1, text("b")), (3, text("b") + " more"), (4, text("c")), (4, text("d")), (0, text("d")), (None, text("e")), (None, text("e")), (None, text("f"))]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for s, (d, t) in zip("xyxyxyxyxyxy", rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.source) for r in out) == sorted([(1, text("a"), "x"), (1, text("b"), "x"), (4, text("c"), "x"), (0, text("d"), "x"), (-1, text("e"), "x"), (-1, text("f"), "y")])
