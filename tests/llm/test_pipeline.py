import hashlib
import random

import corpus_pipeline as P
import public_tokenizers
import pytest
import tiktoken
from metrolith.llm import bpe, pii
from pyspark.sql import functions as F
from test_decontamination import text
from test_near_dup import plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, short and repetitive texts, a benchmark item, personal data, nulls."""
    draw, out = random.Random(12), tmp_path_factory.mktemp("tables")
    item = text(draw, 40)
    rows = [(i, text(draw, draw.choice([30, 80, 300]))) for i in range(60)]
    near = rows[7][1].split()
    near[len(near) // 2] = "changed"
    rows += [(100, rows[5][1]), (101, rows[5][1].upper()), (102, " ".join(near)), (103, "too short"), (104, "again and again we say the same words " * 12), (105, rows[9][1] + " " + item + " " + rows[10][1]), (106, rows[11][1] + " write to someone@example.org or +33 1 23 45 67 89"), (107, None), (108, ""), (None, rows[20][1]), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit(7), "row": F.lit("clash"), "id": F.lit(None).cast("string")})
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), {r[0]: r[1] for r in rows}, item


def test_stages_one_by_one(spark, folder, tmp_path):
    sf, texts, item = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns, name
    ids = {name: sorted((r["doc_id"] for r in rows), key=str) for name, rows in seen.items()}
    assert not {103, 104, 107, 108} & set(ids["quality_rules"]) and len(ids["quality_rules"]) == len(texts) - 4 + 2
    before = [(r["doc_id"], r["text"]) for r in seen["quality_rules"]]
    want = {r[0] for r in plain(before, 80, 5) if r[3]}
    assert set(ids["near_duplicates"]) == want and ids["near_duplicates"].count(3) == 1
    assert {100, 101, 102} & set(ids["near_duplicates"]) == set()
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {105}
    after = {r["doc_id"]: r for r in seen["personal_data"]}
    assert set(after) == set(ids["decontamination"]) and "someone@" not in after[106]["text"] and "[EMAIL]" in after[106]["text"] and "[PHONE]" in after[106]["text"]
    assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in after.values())
    assert all(r["text"] == texts[i] for i, r in after.items() if i != 106)
    path = public_tokenizers.path(P.TOKENIZER)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in seen["encoding"]:
        t = after[r["doc_id"]]["text"]
        assert r["ids"] == own.encode_ordinary(t) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    whole = P.run(spark, sf)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect() if r["doc_id"] is not None) == sorted((r["doc_id"], r["ids_sha256"]) for r in seen["encoding"] if r["doc_id"] is not None)


def test_empty_tables(spark, folder, tmp_path):
    sf, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
