import sys
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
import brute_force as B
from rulespark.llm import decontaminate, pieces, toxicity
from rulespark.llm.queries import ORACLES, QUERIES
from rulespark.llm.vocabulary import Vocabulary

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).persist()
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        assert kept <= ids and len(kept) > 0.5 * len(ids), name
        docs, ids = out, kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, kept boolean, row string, score double"


def rows_of(spark, *pairs):
    return spark.createDataFrame([(d, t, "en", f"s{i}", len(t or ""), 5, False, "r", 9.0) for i, (d, t) in enumerate(pairs)], COLUMNS)


def named(df):
    return sorted(r.source for r in df.collect())


def test_decontamination_drops_rows_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = rows_of(spark, (None, item), (None, "a clean text"), (7, "before " + item), (7, "another clean text"), (8, "clean"), (9, None))
    got = corpus_pipeline.decontamination(spark, docs, SF)
    assert named(got) == ["s1", "s3", "s4", "s5"] and got.columns == docs.columns


def test_near_dedup_keeps_one_row_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    other = " ".join(f"v{i}" for i in range(60))
    docs = rows_of(spark, (7, text), (7, text), (7, other), (3, near), (None, "lone words that stand here alone"), (None, "lone words that stand here alone"), (9, None), (9, None), (10, ""), (None, other + " x"), (7, near))
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    kept = named(got)
    assert got.columns == docs.columns
    assert {"s3", "s6", "s7", "s8", "s9"} <= set(kept) and len(kept) == 6 and len({"s4", "s5"} & set(kept)) == 1
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).collect() == []


def test_stages_take_odd_rows(spark):
    docs = rows_of(spark, (None, None), (1, ""), (1, "plain words " * 2000), (1, "plain words " * 2000), (2, "some other text"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and len(out.collect()) == (5 if name != "near_dedup" else 4), name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    assert all(r.lossless for r in corpus_pipeline.tokenize(spark, docs, SF).collect())


def test_stages_equal_plain_versions(spark, tmp_path):
    """Every stage on what the one before kept, against loops over all pairs."""
    docs = spark.read.parquet(f"{MORE}/documents.parquet").filter("length(text) < 800")
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = texts(now)
        stage(spark, now, MORE).write.parquet(f"file://{tmp_path}/{i}")
        now = spark.read.parquet(f"file://{tmp_path}/{i}")
        after = texts(now)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{MORE}/labels.parquet"))
            plain = [model.scores(*toxicity.T.packed(toxicity.pa.array([t], toxicity.pa.string())))[0] for _, t in before]
            want = [x for x, p in zip(before, plain) if p < 0.5]
            assert want
        elif name == "near_dedup":
            want = [x for x, (d, _, least) in zip(before, B.near(before, 5, 80)) if d == least]
            assert len(want) < len(before)
        elif name == "suffix_dedup":
            want = B.left_over(before, 100)
            assert want != before
        else:
            hashed = lambda t: decontaminate.tokens(decontaminate.pa.array([t], decontaminate.pa.string()))[0]
            items = [p for r in spark.read.parquet(f"{MORE}/benchmark.parquet").collect() if len(p := hashed(r.text))]
            reaches = lambda t: any(sum(x[2] for x in decontaminate.tile(hashed(t), p)) >= 0.8 * len(p) - 1e-9 for p in items)
            want = [x for x in before if not reaches(x[1])]
        assert after == want, name
    ranks, as_bytes = Vocabulary.load().ranks, Vocabulary.load().bytes_at
    got = {r.doc_id: r for r in corpus_pipeline.tokenize(spark, now, MORE).collect()}
    assert len(got) == len(after) and all(r.lossless for r in got.values())
    for d, t in after[:40]:
        ids = []
        for place, w in enumerate(t.split(" ") if t else []):
            for j, p in enumerate(B.plain_cut(w, ranks, pieces.DROPOUT, pieces.SEED, d, place)):
                ids += [ranks[p]] if p in ranks and not (j and p == "▁") else [as_bytes[x] for x in p.encode()]
        assert got[d].ids == ids


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
