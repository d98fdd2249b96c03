"""The pipeline on a planted corpus, against brute force for each stage."""

import random
import re

import corpus_pipeline
from riskpanel.llm import queries

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("ban", "dor", "fel", "gim", "hos", "jul", "kes", "lat")]


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def corpus():
    r = random.Random(11)
    prose = lambda n: "\n".join(" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(n))
    items = [(i, " ".join(r.choice(WORDS) for _ in range(20))) for i in range(5)]
    docs = [(i, prose(8), f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, docs[i][1], "s1") for i in range(5)]  # copies
    docs += [(110 + i, docs[10 + i][1].rsplit(" ", 1)[0] + " changed", None) for i in range(5)]  # near copies
    docs += [(120 + i, prose(4) + "\n" + items[i][1] + "\n" + prose(4), "s2") for i in range(5)]  # benchmark items
    docs += [(130, "too short", "s0"), (131, None, "s0"), (132, "", "s0"), (133, "\n".join(["same words again and again in this line here"] * 9), "s0")]
    return docs, items


def test_run_matches_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def fails(text):
        w = (text or "").split()
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeated = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
        return len(w) < 20 or 100 * len(repeated) > 30 * len(w)

    kept = [(d, t) for d, t, _ in docs if not fails(t)]
    unique = []
    for d, t in sorted(kept):
        a = shingles(t)
        if not any(len(a & shingles(u)) >= 0.8 * len(a | shingles(u)) for _, u in unique):
            unique.append((d, t))
    clean = {d for d, t in unique if not any(len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x)) for _, x in items)}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == clean and len(found) == len(clean) == 60
    sizes = [sum(r.shard == k for r in found) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(sizes[k])) for k in range(8))


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.dtypes == table.dtypes, name
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "shards"]
    assert sorted(queries.QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate(["toxicity", "token_counts", "mix_sources", "chat_format", "order_minhash", "line_dedup", "quality_rules", "suffix_dedup", "shard", "decontaminate", "vector_codes", "neighbours", "resample"], 1))
