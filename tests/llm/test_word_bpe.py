import hashlib
import random

import public_tokenizers as P
import pytest
from metrolith.llm import registry, word_bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")
LETTERS = ["a", "B", "é", "é", "Σ", "İ", "ß", " ", "\n", "\x1c", " ", " ", "1", "9", "'s", "'T", "!", "?", "<|endoftext|>", "<|startoftext|>", "<|", "日", "\U0001f600", "́", "Ⅷ", "²", "Ᲊ", "͸"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    made = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(40))) for _ in range(500)]
    long = "".join(draw.choice("abcdefgh") for _ in range(20_000))
    return [None, "", " \n", "same", "same", "a" * 5000, long, "one two " * 20_000, "<|endoftext|>", *made]


def test_ids_and_text_are_the_librarys(spark, texts):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1), "__text": F.lit(2)})
    both = word_bpe.encode(docs, PATH, decoded=True)
    apart = word_bpe.decode(word_bpe.encode(docs, PATH), PATH)
    assert both.schema == apart.schema and both.exceptAll(apart).count() == apart.exceptAll(both).count() == 0
    out = {r.doc_id: r for r in word_bpe.id_digest(both).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].decoded == library.decode(ids, skip_special_tokens=False) and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_every_letter_is_split_as_by_the_library():
    library, own = Tokenizer.from_file(PATH), word_bpe.WordEncoder(PATH)
    for c in [*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1E000, 0x20000)]:
        text = f"a{chr(c)}B1"
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_scan_and_heap_agree():
    own, draw = word_bpe.WordEncoder(PATH), random.Random(1)
    for n in [1, 2, 3, 50, 400]:
        for letters in ("ab", "thein", "aaaaaaab"):
            parts = [own.vocab[draw.choice(letters)] for _ in range(n)]
            assert own.pop(list(parts)) == own.scan(list(parts))


def test_a_small_store_changes_nothing(texts):
    wide, narrow = word_bpe.WordEncoder(PATH), word_bpe.WordEncoder(PATH, 2000)
    for t in texts[9:]:
        assert wide.encode(t).tolist() == narrow.encode(t).tolist()
    assert narrow.of_chunk.held <= 3000


def test_null_and_unknown_ids(spark):
    given = spark.createDataFrame([(None,), ([],), ([320, 60_000, 49_407],)], "ids array<int>")
    assert [r.decoded for r in word_bpe.decode(given, PATH).collect()] == ["", "", "a</w> <|endoftext|>"]


def test_query_over_the_driver_table(spark):
    library = Tokenizer.from_file(PATH)
    out = registry.queries()["op13_word_bpe"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = {r.doc_id: r for r in out.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id][1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert word_bpe.encode(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false"), PATH).count() == 0
