import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from packetloom.llm import registry, shared
from packetloom.llm import tokens as tk

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "pages", "benchmark")


def test_words_match_the_pattern():
    rng = np.random.default_rng(0)
    texts = [None, "", " ", "a", " é x\x0b日本\r\n b ", *("".join(rng.choice(list("ab é\n\t日"), rng.integers(0, 30))) for _ in range(200))]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}).slice(1)
    got = []
    for _, some in tk.slices(batch, limit=64):
        starts, ends, first = some.words()
        words = [some.buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        got += [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [re.findall(shared.WORD, t or "") for t in texts[1:]]


def test_equal_spans_have_equal_hashes_and_others_do_not():
    words = ["a", "b", "ab", "ba", "aa", "aab", "A", "é", "e", "ab"]
    texts = tk.texts_of(pa.array([" ".join(words)]))
    starts, ends, first = texts.words()
    h = texts.hashes(starts, ends)
    assert len({*h.tolist()}) == len({*words}) and h[2] == h[9]
    low = texts.hashes(starts, ends, lower=True)
    assert low[6] == low[0]
    at, grams = tk.windows(h, first, 2)
    assert len(at) == 9 and len({*grams.tolist()}) == 9


def test_windows_stay_within_texts():
    texts = tk.texts_of(pa.array(["a b", "c", "", "d e f"]))
    starts, ends, first = texts.words()
    at, _ = tk.windows(texts.hashes(starts, ends), first, 2)
    assert at.tolist() == [0, 3, 4]


def test_a_cut_table_is_read_from_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "cast(null as string) as s")
    again = shared.cut(df, "test")
    assert again.schema.names == df.schema.names and sorted(r.id for r in again.collect()) == list(range(10))
    assert all(f.startswith(shared.shared_dir(spark).removeprefix("file://")) or f.startswith(shared.shared_dir(spark)) for f in (x.removeprefix("file://") for x in again.inputFiles()))


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(r) for r in want.select(*map(duckdb.ColumnExpression, columns)).fetchall()), key=str)


def test_every_number_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["op3_mixing", "op6_decontam", "op9_sharding", "op10_url_filter"])
def test_native_plans_have_no_python(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
