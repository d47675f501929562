import os

import pytest

pytest.importorskip("stellate.llm")
pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_stages_keep_columns_and_follow_brute_force(spark):
    from stellate.llm import quality, secret_scan
    from stellate.llm.tables import table, written

    from .test_text_operators import components_brute, fingerprint_brute, suffix_brute

    docs = table(spark, SF, "documents")
    columns = docs.columns
    rejected = {r["doc_id"] for r in quality.classify(docs, table(spark, SF, "labels")).filter("predicted = 0").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        now = {r["doc_id"]: r.asDict().get("text") for r in docs.collect()}
        if name == "quality_classifier":
            assert now == {i: t for i, t in before.items() if i not in rejected}
        elif name == "simhash_near_dedup":
            root = components_brute([fingerprint_brute(t) for t in before.values()])
            first = {}
            for i in sorted(before):
                first.setdefault(root[fingerprint_brute(before[i])], i)
            assert now == {i: before[i] for i in first.values()}
        elif name == "suffix_array_dedup":
            ids = sorted(before)
            want = dict(zip(ids, suffix_brute([before[i].encode() for i in ids]), strict=True))
            assert all(now[i] == want[i][3].decode("utf-8", "ignore") for i in ids)
        elif name == "secret_scans":
            assert now == {i: secret_scan.redacted(t) for i, t in before.items()}
        if name != "packing":
            assert docs.columns == columns and docs.filter("n_chars <> length(text)").count() == 0
        else:
            assert set(now) == set(before)
        before = now
        seen.append(name)
    assert len(seen) == 5


CLASHING = ("__h", "__t", "__nb", "__spans", "__key", "__n", "text_hash", "cut_spans", "kept_key", "copy", "fp", "x", "sequence_id")


@pytest.mark.parametrize("classes", [2, 1, 0])
def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path, classes):
    """Nulls, empty texts, repeated rows and keys, more columns; a null stays null and the columns ride along."""
    from stellate.llm.tables import written

    from .conftest import prose, rows

    data = [(i, t, "en", "s", None if t is None else len(t), *(f"{c}{n}" for c in CLASHING)) for n, (i, t) in enumerate([*rows(), (5, prose(1, 400)), (41, prose(50, 300)), (41, prose(51, 300)), (None, None)])]
    data += data[-3:]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    marks = [(i, int(i % 2)) for i in range(12)] if classes == 2 else [(i, 0) for i in range(12)] if classes else []
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (data, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in pipeline.STAGES:
            before = docs
            docs = written(stage(spark, docs, str(tmp_path)), name)
            if name == "packing":
                assert docs.select("doc_id", "start").distinct().count() <= docs.count()
                assert docs.filter("start = 0").count() == before.count()
                continue
            assert docs.columns == before.columns
            rest = [c for c in docs.columns if c not in ("text", "n_chars")]
            assert docs.select(*rest).exceptAll(before.select(*rest)).count() == 0  # rows go, nothing else changes
            if name == "quality_classifier" and classes < 2:
                assert docs.count() == before.count()
            if name == "simhash_near_dedup" and some:
                assert docs.filter("text is null or text = ''").count() <= 1 and docs.count() >= min(8, before.count() // 3)
            if name in ("suffix_array_dedup", "secret_scans"):
                assert docs.count() == before.count() and docs.filter("text is null").count() == before.filter("text is null").count()
