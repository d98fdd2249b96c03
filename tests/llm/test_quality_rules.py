"""Cleaning by the quality rules: frequent lines go from the kept texts."""

import corpus_pipeline
from riskpanel.llm import quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    own = lambda i: "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(12)) for j in range(4))
    out = [(i, f"Share  THIS page\n{own(i)}\n\nshare this page\n", "en", "a") for i in range(30)]
    out += [(100 + i, f"share this page\n{own(100 + i)}", "en", None) for i in range(5)]  # not frequent in its host
    out += [(200, out[0][1], "en", "b"), (None, out[1][1], "en", "a"), (300, "share this page\n" * 20 + "a b c", "en", "a"), (301, None, "en", "a")]
    return [(*x, len(x[1] or "")) for x in out]


def test_frequent_lines_go(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    out = corpus_pipeline.quality(spark, docs, "")
    assert out.dtypes == docs.dtypes
    want = []
    for i, text, lang, source, n in rows():
        if i in (300, 301):
            continue
        if source == "a":
            text = "\n".join(x for x in text.split("\n") if " ".join(x.lower().split()) != "share this page")
        want.append((str(i), text, lang, source, len(text)))
    found = [(str(r.doc_id), r.text, r.lang, r.source, r.n_chars) for r in out.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    whole = quality_rules.filter_documents(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in whole) == sorted((str(i), t) for i, t, _, _, _ in rows() if i not in (300, 301))
