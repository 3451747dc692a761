import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from metrolith.llm import bpe, token_counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = " abthe'sl\n\t1é2ñ日<|endoftext|>!#ing\u00a0\U0001f600"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    made = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(50))) for _ in range(400)]
    return [None, "", " \n\n  ", "x<|endoftext|>y <|endoftext|>", "a" * 3000, "thethethe" * 200, "".join(draw.choice("abcdefgh") for _ in range(20_000)), "same", "same", *made]


@pytest.fixture(scope="module")
def docs(spark, texts):
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return given.withColumns({"ids": F.lit("clash"), "bytes": F.lit(1), "n_tokens": F.lit(None).cast("int")})


def test_counts_are_the_librarys(docs, texts):
    library = Tokenizer.from_file(JSON)
    out = {r.doc_id: r for r in token_counts.count_tokens(docs, JSON, P.PATTERN, 20, with_prefixes=True).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len(t.encode()), n, n > 20)
        assert len(library.encode(t[: out[i].fit_chars], add_special_tokens=False).ids) <= 20
        assert (out[i].prefix_tokens or [0])[-1] == n


def test_every_prefix_has_its_exact_count(texts):
    library, own = Tokenizer.from_file(JSON), token_counts.PrefixCounter(JSON, P.PATTERN)
    for t in texts[1:4] + texts[9:120]:
        for cut in range(len(t) + 1):
            assert own.prefix(t, cut) == len(library.encode(t[:cut], add_special_tokens=False).ids), (t, cut)
    data = "thereinafter"
    assert list(own.table(data)) == [len(own.plain(data[:i].encode())) for i in range(1, len(data) + 1)]


def test_ids_are_the_librarys_and_decode_back(docs, texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    coded = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    together = bpe.encode(docs, RANKS, P.PATTERN, decoded=True)
    assert together.schema == coded.schema and together.exceptAll(coded).count() == coded.exceptAll(together).count() == 0
    out = {r.doc_id: r for r in bpe.id_digest(coded).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert out[i].ids == ids and bytes(out[i].bytes) == (t or "").encode() and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_replay_falls_back_where_a_lower_rank_turns_up_late():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 400, b"abc": 300, b"zz": 256}
    table = bpe.MergeReplay(ranks)
    words = [b"abc", b"abcabc", b"zzzzz", b"xabcbc", b"bcabc"]
    assert [x.tolist() for x in table.replay(words)] == [table.one_word(w) for w in words]


def test_empty_table(docs):
    none = docs.where("false")
    assert token_counts.count_tokens(none, JSON, P.PATTERN, 5).count() == 0
    assert bpe.decode(bpe.encode(none, RANKS, P.PATTERN), RANKS).count() == 0


def test_long_words_are_not_kept():
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    own = bpe.BlockEncoder(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert [x.tolist() for x in own.encode([long, "ab " + long, "ab"])] == [library.encode_ordinary(t) for t in (long, "ab " + long, "ab")]
    assert max(map(len, own.known)) <= bpe.LONGEST_KEPT and "ab" in own.known
    counter = token_counts.PrefixCounter(JSON, P.PATTERN)
    assert sum(counter.counts(long[:3000] + " ab")[1]) == len(Tokenizer.from_file(JSON).encode(long[:3000] + " ab", add_special_tokens=False).ids)
    assert max(map(len, counter.tables)) <= token_counts.LONGEST_KEPT


def test_a_byte_costs_the_tokens_that_end_there_not_all_sizes():
    class Asked(dict):
        times = 0

        def get(self, key, default=None):
            self.times += 1
            return super().get(key, default)

    counter, word = token_counts.PrefixCounter(JSON, P.PATTERN), "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    counter.id = Asked(counter.id)
    assert counter.table(word)[-1] == len(Tokenizer.from_file(JSON).encode(word, add_special_tokens=False).ids)
    assert counter.id.times < len(word)


def test_counts_stay_when_the_stores_are_emptied(texts, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 40)
    library, own = Tokenizer.from_file(JSON), token_counts.PrefixCounter(JSON, P.PATTERN)
    for t in [t for t in texts if t]:
        assert sum(own.counts(t)[1]) == len(library.encode(t, add_special_tokens=False).ids)
        assert max(len(own.steps), len(own.seams), len(own.tables)) <= 41
