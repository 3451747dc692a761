import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from metrolith.llm import alignment, registry
from metrolith.llm.scratch import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LETTERS = ["a", "b", "the", " ", " ", "  ", "\n", "é", "ñ", "日本", "\U0001f600", "ing", "1", "22", "'s", "<|endoftext|>", "<s>", "\0", "ﷺ", "é"]


@pytest.fixture(scope="module")
def library():
    byte = Tokenizer.from_file(A)
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(alignment.byte_letters())}

    def tokens(text):
        """(id, bytes) of both sides."""
        if not text:
            return [], []
        a = [(i, bytes(letters[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids]
        shown = lambda i: bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()
        b = [(i, shown(i)) for i in piece.encode(text)]
        want = (" " + text).encode()
        return (a, b) if want == b"".join(x for _, x in a) == b"".join(x for _, x in b) else ([], [])

    return tokens


def groups(a, b):
    """Token by token: the side that is behind goes on; where both stand at one place a group ends."""
    out, ga, gb, at_a, at_b = [], [], [], 0, 0
    a, b = list(a), list(b)
    while a or b:
        if at_a <= at_b:
            i, x = a.pop(0)
            ga.append(i)
            at_a += len(x)
        else:
            i, x = b.pop(0)
            gb.append(i)
            at_b += len(x)
        if at_a == at_b and gb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def contract(rows, tokens):
    found = [(i, *tokens(t)) for i, t in rows]
    found = [(i, a, b, groups(a, b)) for i, a, b in found]
    documents, best = Counter(), defaultdict(int)
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for *_, g in found]
    for c in links:
        documents.update(c.keys())
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    out = []
    for (i, a, b, g), c in zip(found, links, strict=True):
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        n_best = sum(n for p, n in c.items() if documents[p] == best[p[0]])
        out.append((i, len(a), len(b), len(g), sum(c.values()), n_best, sum(n * documents[p] for p, n in c.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def texts(seed):
    draw = random.Random(seed)
    made = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(40))) for _ in range(300)]
    return [None, "", " ", "  ", "a", " a ", "a  b", "a ", " \n  x", "same text", "same text", "has ▁ inside", "a" * 3000, "".join(draw.choice("abcdefgh ") for _ in range(9_000)), *made]


@pytest.mark.parametrize("hot,block,large", [(alignment.HOT_PAIRS, alignment.BLOCK_BYTES, alignment.LARGE_GROUP), (20, 7, 3)])
def test_matches_brute_force(spark, library, monkeypatch, hot, block, large):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    rows = [*enumerate(texts(hot)), (5, "again"), (None, "again")]
    if block < 1000:
        rows = [(i, t and t[:300]) for i, t in rows]  # the worker has its own module: small blocks are tested in this process below
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "links": F.lit(1), "__row": F.lit(2), "a": F.lit(3)})
    aligned = alignment.align(docs, A, B, P.PATTERN)
    out = alignment.count_links(table(aligned), 50_257).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, digest(r.groups)) for r in out), key=str) == contract(rows, library)


def test_the_machine_takes_events_in_any_pieces(library, monkeypatch):
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    own = alignment.side(A, P.PATTERN), alignment.side(B, P.PATTERN)
    draw = random.Random(2)
    machine = alignment.Machine(len(own[0].raw), len(own[1].raw))
    for t in texts(8)[4:]:
        both = library(t)
        if not both[0]:
            continue
        machine.begin()
        at, until = [0, 0], 0
        while at[0] < len(both[0]) or at[1] < len(both[1]):
            until += draw.randrange(1, 60)  # bytes
            for k in (0, 1):
                part = []
                while at[k] < len(both[k]) and machine.reached[k] + sum(len(x) for _, x in part) + len(both[k][at[k]][1]) <= until:
                    part.append(both[k][at[k]])
                    at[k] += 1
                if part:
                    machine.take(k, own[k].size[[i for i, _ in part]], draw_ids(part))
            machine.close()
        expected = groups(*both)
        shown, a, b, times = machine.finish()
        assert shown == ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in expected)
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), times.tolist(), strict=True)) == Counter((x, y) for ga, gb in expected for x in ga for y in gb)
        assert machine.n_groups == len(expected) and machine.n_links == times.sum() and not len(machine.ends[0]) and not len(machine.ends[1])


def draw_ids(part):
    import numpy as np

    return np.array([i for i, _ in part], dtype=np.int32)


def test_ids_are_the_libraries(library):
    own = alignment.side(A, P.PATTERN), alignment.side(B, P.PATTERN)
    for t in texts(4)[2:]:
        for side, expected in zip(own, library(t), strict=True):
            if expected:
                assert side.ids(" " + t).tolist() == [i for i, _ in expected]
    assert alignment.side(B, P.PATTERN).ids(" has ▁ inside").min() == -1


@pytest.fixture(scope="module")
def plain():
    """Chunks without spaces: every letter but the two that stand for spaces, pieces and letters in odd orders, long ones."""
    draw = random.Random(6)
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = [p for p in (model.id_to_piece(i).replace("\u2581", "") for i in range(model.get_piece_size())) if p]
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in " \u2581"]
    mixed = ["".join(draw.choice(draw.choice((pieces, letters[:700], letters, "aeiou\n\0"))) for _ in range(draw.randrange(1, 12))) for _ in range(60_000)]
    return [*letters, *pieces, *mixed, "a" * 30_000, "".join(draw.choice("abcdeé日") for _ in range(30_000))]


def test_pieces_by_ranks_are_the_librarys(plain):
    model, own = sentencepiece.SentencePieceProcessor(model_file=B), alignment.side(B, P.PATTERN)
    for i in range(0, len(plain), 5_000):
        t = " ".join(plain[i : i + 5_000])
        assert own.ids(" " + t).tolist() == model.encode(t)


def test_new_words_need_no_call_of_the_library(library):
    """Each distinct word was a call of its own, half of all CPU seconds where most words are new."""
    own = alignment.PieceSide(B, P.PATTERN)
    t = "new words" + "".join(f" w{i}é" for i in range(1000))
    own.model = None
    assert own.ids(" " + t).tolist() == [i for i, _ in library(t)[1]]


def test_models_that_ranks_do_not_state_are_coded_by_the_library(tmp_path, library):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    def changed(change):
        with open(B, "rb") as file:
            spec = ModelProto.FromString(file.read())
        change(spec)
        (tmp_path / "m.model").write_bytes(spec.SerializeToString())
        return alignment.PieceSide(str(tmp_path / "m.model"), P.PATTERN)

    def tie(spec):
        spec.pieces[300].score = spec.pieces[301].score

    for change in (tie, lambda s: setattr(s.normalizer_spec, "remove_extra_whitespaces", True), lambda s: setattr(s.trainer_spec, "model_type", 1)):
        own = changed(change)
        assert own.encode is None
        assert own.ids(" the same text").min() >= 0
    own = changed(lambda s: setattr(s.normalizer_spec, "remove_extra_whitespaces", True))
    assert own.ids("  two  spaces").tolist() == [-1]


def test_query_over_the_driver_table(spark, library):
    out = registry.queries()["op12_alignment"](spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    rows = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=str) == contract(rows, library)
    none = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B, P.PATTERN)
    assert alignment.count_links(table(none), 50_257).count() == 0


def test_every_token_is_what_its_bytes_merge_to():
    """So ranks give the ids that the list of merges gives."""
    own = alignment.side(A, P.PATTERN)
    texts = [(i, t.decode("utf-8", "ignore")) for i, t in enumerate(own.raw) if t]
    whole = [(i, t) for i, t in texts if t.encode() == own.raw[i]]
    assert len(whole) > 45_000 and all(own.ids(t).tolist() == [i] for i, t in whole)
