"""Null ids and ids that several texts share: each row is judged by its own text."""

from collections import Counter

from riskpanel.llm import decontaminate, order_minhash

KIND = "doc_id long, text string, lang string"


def words(k, n=30):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_near_duplicates_go_by_row(spark):
    near = words(1) + " more"
    rows = [(1, words(1)), (None, near), (None, words(2)), (None, words(3)), (None, words(3)), (7, words(1)), (7, words(4)), (8, words(4) + " more"), (9, None), (9, ""), (None, None), (None, "")]
    df = spark.createDataFrame([(*x, "en") for x in rows], KIND)
    out = order_minhash.filter_documents(df)
    assert out.dtypes == df.dtypes
    want = [(1, words(1)), (None, words(2)), (None, words(3)), (7, words(4)), (9, None), (9, ""), (None, None), (None, "")]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


def test_contaminated_rows_go_by_text(spark):
    item = words(50, 20)
    half = item.split()
    rows = [(None, f"{words(1)} {item}"), (None, words(2)), (5, f"{words(3)} {item}"), (5, words(4)), (6, " ".join(half[:12])), (6, " ".join(half[8:])), (7, None)]
    df = spark.createDataFrame([(*x, "en") for x in rows], KIND)
    out = decontaminate.filter_documents(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.dtypes == df.dtypes
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([rows[1], *rows[3:]])
