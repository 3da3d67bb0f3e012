"""The queries that have SQL, against it."""

import duckdb
import pytest

from ledgerlake.llm import queries

DIR = "/root/testdata/sf0.001"
TABLES = ["documents", "pages"]


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(r[k] for k in order) for r in found), key=repr)


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder if t == 'documents' else DIR}/{t}.parquet{'/*.parquet' if folder != DIR and t == 'documents' else ''}')")
    df = queries.queries()[name](spark, str(folder))
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_given_tables(spark, name):
    compare(spark, name, DIR)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_spelling_variants"])
def test_nulls_repeats_and_ties(spark, tmp_path, name):
    docs = [(k, f"winter's{k % 9} WINTERS wïnters wintres {'spring' * (k % 4)}", ["en", "fr", None, "Ä"][k % 4], None if k % 5 else "s", None if k % 3 else k) for k in range(300)]
    docs += [(None, "winters", "en", "s", 1), (None, None, None, None, None), (7, "", "en", "s", 4)] + [(9, "repeat repeats", "en", "s", 4)] * 7
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, name, tmp_path)
