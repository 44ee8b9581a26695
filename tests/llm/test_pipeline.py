"""The pipeline's stages against brute force on a small fixture, each on its own input."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from packetloom.llm.registry import SHARDS, mix_levels

from . import test_decontam, test_mixing, test_near_dup, test_quality, test_sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs, labels = test_quality.corpus(5, 240)
    rng = np.random.default_rng(1)
    texts = dict(docs)
    good = [k for k, q, t in labels if q and not t]
    for k in range(20):  # near copies, exact copies, and benchmark passages in clean documents
        w = texts[good[k]].split()
        w[3] = "changed"
        texts[90_000 + k] = " ".join(w)
        texts[91_000 + k] = texts[good[k]]
    items = [(k, " ".join(f"q{x}" for x in rng.integers(0, 99, 30))) for k in range(5)]
    for k in range(20, 30):
        texts[good[k]] += " " + items[k % 5][1]
    texts[92_000], texts[92_001] = "", None
    rows = [(k, t, "en" if k % 3 else "de", f"src{k % 6}", len(t or "")) for k, t in texts.items()]
    tables = {
        "documents": pa.Table.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])),
        "labels": pa.table({c: pa.array(v, t) for (c, t), v in zip([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())], zip(*labels, strict=True), strict=True)}),
        "benchmark": pa.table({"item_id": [k for k, _ in items], "text": [t for _, t in items]}),
    }
    for name, t in tables.items():
        pq.write_table(t, folder / f"{name}.parquet")
    found, df = [rows], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, f) in enumerate(cp.STAGES):
        out = f(spark, df, str(folder))
        if k < len(cp.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(f"{folder}/out{k}")
        df = spark.read.parquet(f"{folder}/out{k}")
        found.append([tuple(r) for r in df.collect()])
    return str(folder), found, items, labels


def ids(rows):
    return sorted(r[0] for r in rows)


def test_quality_stage(stages):
    _, found, _, labels = stages
    kept = set(ids(found[1]))
    assert set(found[1]) <= set(found[0])
    clean = [k for k, q, t in labels if q and not t]
    bad = [k for k, q, t in labels if not q or t]
    assert np.mean([k in kept for k in clean]) > 0.97 and np.mean([k in kept for k in bad]) < 0.05 and not kept & {92_000, 92_001}


def test_near_duplicate_stage(stages):
    _, found, *_ = stages
    first = {c for _, c, _ in test_near_dup.brute([r[:2] for r in found[1]])}
    assert ids(found[2]) == sorted(first) and set(found[2]) <= set(found[1])


def test_decontamination_stage(stages):
    _, found, items, _ = stages
    clean = sorted(r[0] for r in test_decontam.brute([r[:2] for r in found[2]], items) if not r[5])
    assert ids(found[3]) == clean and len(found[3]) < len(found[2])


def test_mixing_stage(stages):
    _, found, *_ = stages
    domains = ("web", "books", "code", "forum")
    rows = [(k, t, domains[int(s[3:]) % 4], lang, s) for k, t, lang, s, _ in found[3]]
    taken = sorted(k for k, _, n in test_mixing.brute(rows, mix_levels(), cp.MIX_SHARE, 1) if n)
    assert ids(found[4]) == taken and set(found[4]) <= set(found[3])


def test_sharding_stage(stages):
    _, found, *_ = stages
    assert sorted(found[5], key=str) == test_sharding.brute([r[:2] for r in found[4]], [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def test_run_gives_the_last_stage(spark, stages):
    folder, found, *_ = stages
    assert sorted(map(tuple, cp.run(spark, folder).collect()), key=str) == sorted(found[5], key=str)
