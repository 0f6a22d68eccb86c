import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import awkward, cluttered, nothing
from tillmark.llm import fingerprints as FP


def expected(rows):
    """Edited texts, by (doc_id, text); rows follow each other in descending doc_id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        share = len(text) // 3
        out.setdefault(doc, []).append((len(text), text[: len(text) - share] + after[:share]))
    return out


def test_edited_texts_across_ranges(spark):
    rows = [(i * 7 - 20, f"document {i} " + "word " * (i % 13) + "é" * (i % 5)) for i in range(200)] + [(None, "last\none"), (2000, None)]
    docs = cluttered(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    for bucket_rows in (500, 9):
        got = {r["doc_id"]: r for r in FP.edited_documents(docs, bucket_rows=bucket_rows).collect()}
        assert len(got) == len(rows)
        for doc, ((n, edited),) in expected(rows).items():
            assert got[doc]["n_chars"] == n
            assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[doc]["near_edited"] <= 1 and 0 <= got[doc]["near_next"] <= 1


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    got = FP.edited_documents(docs).collect()
    assert len(got) == docs.count()
    copies = {r["fingerprint"] for r in got if r["doc_id"] in (1, 4)}
    assert len(copies) == 1
    assert {r["fingerprint"] for r in got if r["doc_id"] == 2} == {r["fingerprint"] for r in got if r["doc_id"] == 3}
    assert FP.edited_documents(nothing(spark)).count() == 0
    alone = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    (row,) = FP.edited_documents(alone).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_order_does_not_matter_but_multiplicity_does(spark):
    texts = ["a b\nc d\ne", "e\na b\nc d", "a b\nc d\ne\ne", "a b\nc d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [r["fingerprint"] for r in FP.fingerprints(docs).orderBy("doc_id").collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 3
    assert all(len(p) == FP.WIDTH for p in prints)


def test_insertion_and_deletion(spark):
    docs = spark.createDataFrame([(1, "x y z\nq"), (2, "new one\nagain"), (3, "x y z\nq\nnew one\nagain")], "doc_id long, text string")
    rows = {r["doc_id"]: r["lanes"] for r in FP.lanes(docs, ["doc_id"], "text").collect()}
    frame = spark.createDataFrame([(rows[1], rows[2], rows[3])], "a array<long>, b array<long>, c array<long>")
    row = frame.select(FP.merged(F.col("a"), F.col("b")).alias("plus"), FP.merged(F.col("c"), F.col("b"), -1).alias("minus"),
                       FP.from_text(FP.as_text(F.col("c"))).alias("back")).first()
    assert row["plus"] == rows[3] and row["minus"] == rows[1] and row["back"] == rows[3]


def test_likeness_follows_the_common_part(spark):
    base = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(i, " ".join(base[: 900 - 100 * i] + [f"v{j}" for j in range(100 * i)])) for i in range(10)],
                                 "doc_id long, text string")
    lanes = FP.lanes(docs, ["doc_id"], "text")
    first = lanes.where("doc_id = 0").select(F.col("lanes").alias("first"))
    near = {r["doc_id"]: r["near"] for r in lanes.join(first).select(
        "doc_id", FP.likeness(F.col("first"), F.col("lanes")).alias("near")).collect()}
    assert near[0] == 1.0 and near[1] > 0.75 and near[9] < 0.5
