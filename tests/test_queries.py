"""Every query with an oracle gives the rows of its SQL on DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    text = df.map(lambda v: "" if v is None or v != v else str(round(v, 6)) if isinstance(v, float) else str(v))
    return sorted(map(tuple, text.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_oracle(spark, db, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_char_chunks_equal_a_plain_loop(spark):
    got = {}
    for r in entry.queries()["char_chunks"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.chunk_id] = r.chunk
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, used = [], 0
        for w in d.text.split():
            if want and used + len(w) + 1 <= 400:
                want[-1] += " " + w
                used += len(w) + 1
            else:
                want.append(w)
                used = len(w) + 1
        assert [got.get(d.doc_id, {})[i] for i in range(len(want))] == want and len(got.get(d.doc_id, {})) == len(want)


def test_rule_extraction(spark):
    rows = {r.section_id: r for r in entry.queries()["rule_extraction"](spark, SF).collect()}
    kinds = {r.id: r.chunk_type for r in entry.queries()["chunk_classify"](spark, SF).collect()}
    assert rows["1"].chunk_type == "policy_rule" and rows["1"].publishable and rows["101"].chunk_type == "policy_list" and rows["101"].confidence == 0.9
    assert all(r.chunk_type in (kinds[int(i)], "policy_list") for i, r in rows.items() if int(i) in kinds) and len(rows) == len(kinds) + 6


def test_list_topics(spark):
    got = {r.id: r.topic for r in entry.queries()["list_topics"](spark, SF).collect()}
    assert got[1] == "Holidays" and got[2] == "Tools" and got[4] == "Categories"


def test_publish_gate_judges_every_document(spark):
    got, docs = entry.queries()["publish_gate"](spark, SF), spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())


def test_line_coverage_holds_lines_against_the_whole_text(spark):
    got = {r.doc_id: r for r in entry.queries()["line_coverage"](spark, SF).collect()}
    texts = {r.doc_id: [" ".join(x.split()) for x in r.text.split("\n")] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text.isascii()}
    solid = {i: [x for x in t if sum(c.isalnum() for c in x) >= 2 and len(x.split(" ")) >= 4] for i, t in texts.items()}
    assert solid and all(got[i].covered >= len([x for x in s if not set(x) <= set("0123456789 |/:.-") and not x.lower().startswith("page")]) for i, s in solid.items())
