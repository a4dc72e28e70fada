"""Text queries over all documents against brute force."""

import re

from tallyloom.plans import catalogue

TEXTS = ["The cat, sat.", "the CAT sat", "Caf\u00e9 \u201cone\u201d two", "caf\u00e9 one, two!", "cafe one two", "Привет, мир", "привет мир", "日本語", "中文", "a\u00a0b", "a b", " a\u00a0\u00a0b ", "a\u2003b", "x\ny", None]


def documents(spark, tmp_path):
    rows = [(k, t, ["en", "de", "fr"][k % 3]) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_near_duplicates_of_all_documents(spark, tmp_path):
    first, want = {}, {}
    for k, t in enumerate(TEXTS):
        want[k] = first.setdefault(tuple(re.findall(r"\w+", (t or "").lower())), k)
    assert {r.doc_id: r.lowest for r in catalogue.QUERIES["near_duplicate_lowest_id"](spark, documents(spark, tmp_path)).collect()} == want


def test_no_op_edits_of_all_documents(spark, tmp_path):
    want = {k: (None, None) if t is None else (True, len(t) != len(" ".join(t.split()))) for k, t in enumerate(TEXTS)}
    assert {r.doc_id: (r.no_op, r.reformatted) for r in catalogue.QUERIES["no_op_edits"](spark, documents(spark, tmp_path)).collect()} == want
