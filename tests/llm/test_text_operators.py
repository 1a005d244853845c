"""BPE, token counts, personal data: exact against libraries and plain versions, with odd inputs."""

import array
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from themeloom.llm import bpe, pii_bootstrap, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "word " * 30_000, "x" * 20_000, "naïve café — 漢字 😀", "<|endoftext|> <s>", "tab\tand\x00null", "  two  spaces ", "3.14 + 2,718"]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN)


def odd_docs(spark):
    rows = [(i, text, "extra", 7) for i, text in enumerate(ODD)] + [(3, "again", "x", 1), (3, "again", "x", 1), (None, "no id", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_transducer_agrees_with_library_on_random_bytes(codec, library):
    draw, tokens = random.Random(5), list(codec.ranks)
    for turn in range(4000):
        piece = [
            lambda: draw.randbytes(draw.randint(1, 30)),
            lambda: b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 5))),
            lambda: draw.choice(tokens)[:12] * draw.randint(1, 6),
        ][turn % 3]()
        assert list(array.array("I", codec.pieces.transducer.encode(piece))) == library._core_bpe.encode_single_piece(piece)


def test_tables_may_be_forgotten_at_any_time(library):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, pieces=4)
    text = "Several words, then several more words and words."
    assert list(array.array("I", codec.encode(text))) == library.encode_ordinary(text)


def test_utf8_in_parts_reads_as_in_one(codec):
    draw = random.Random(2)
    for _ in range(500):
        data = draw.randbytes(6) + "é漢😀".encode()[: draw.randint(0, 9)] + draw.randbytes(3)
        reader, at = bpe.Utf8Reader(), draw.randint(0, len(data))
        assert reader.feed(data[:at]) + reader.feed(data[at:]) + reader.finish() == data.decode("utf-8", "replace")


def test_encode_and_decode_columns(spark, library):
    encoded = bpe.encode(odd_docs(spark), RANKS, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 3
    for row in rows:
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
        assert row["decoded"] == (row["text"] or "")


def test_round_trip_digests(spark, library):
    rows = bpe.round_trip(odd_docs(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert rows[0].__fields__.count("n_tokens") == 1
    for row in rows:
        ids = library.encode_ordinary(row["text"] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def test_empty_tables(spark):
    empty = odd_docs(spark).limit(0)
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(empty, PIECES).count() == 0
    assert pii_bootstrap.find(empty).count() == 0


def test_token_counts_agree_with_library(spark, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.count_tokens(odd_docs(spark), PIECES).collect()
    want = [(d["doc_id"], len((d["text"] or "").encode()), len(model.encode(d["text"] or ""))) for d in odd_docs(spark).collect()]
    order = lambda row: (row[0] is None, row[0] or 0, row[1], row[2])
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)


def test_pre_tokens_cut_where_no_piece_goes_on():
    cutter = token_counts.pieces(PIECES)
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice("ab é\n\t  .,0129▁漢あ😀\x00ñß<s></s>ＡⅫ") for _ in range(draw.randint(1, 25)))
        parts = cutter.cut(text)
        assert int(cutter.count(parts).sum()) == len(cutter.model.encode(text)), text


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if kind == "ip" and any(int(part) > 255 for part in match[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((match.start(), pii_bootstrap.KINDS.index(kind), match.end()))
    return sorted(found)


def test_base_spans_match_their_patterns():
    draw = random.Random(3)
    for _ in range(6000):
        text = "".join(draw.choice(["a", "@", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "b.c", "4111111111111111", "é", "%"]) for _ in range(draw.randint(1, 22)))
        assert pii_bootstrap.base_spans(text) == plain_spans(text), text


def test_long_runs_are_read_once():
    text = "9" * 60_000 + " " + "a" * 60_000 + " x@y.zz " + "1." * 20_000
    assert (120_002, 0, 120_008) in pii_bootstrap.base_spans(text)


def test_contexts_find_what_patterns_miss(spark):
    known = [(i, f"some words here reach me at: user{i}@mail.example.com or not") for i in range(40)]
    unseen = [(100, "other prose reach me at: someone2[at]mail.example fine"), (101, "it cost of: 12345678 coins"), (102, None), (103, "")]
    found = {row["doc_id"]: row for row in pii_bootstrap.find(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()}
    assert len(found) == 44
    assert found[100]["n_email"] == 0 and found[100]["spans"] == "email:25:49"
    assert found[101]["spans"] == "" and found[102]["spans"] == "" and found[103]["spans"] == ""
    assert found[5]["n_email"] == 1 and found[5]["spans"].startswith("email:")
    digest = ",".join(f"email:{b}:{e}" for b, _, e in plain_spans(known[5][1]))
    assert found[5]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()


def test_few_slots_are_not_enough(spark):
    docs = [(i, f"reach me at: user{i}@mail.example.com") for i in range(3)] + [(9, "reach me at: someone2[at]mail.example")]
    found = pii_bootstrap.find(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found.filter("doc_id = 9").first()["spans"] == ""
    assert found.agg(F.sum("n_email")).first()[0] == 3


def test_a_piece_of_millions_of_letters_takes_linear_time_and_bounded_states(library):
    draw = random.Random(5)
    letters = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    transducer = bpe.Transducer(bpe.load_ranks(RANKS), 20_000)
    took = []
    for n in (len(letters) // 4, len(letters)):
        begin = time.perf_counter()
        ids = transducer.encode(letters[:n].encode())
        took.append(time.perf_counter() - begin)
        assert len(transducer._states) <= 20_001 and len(transducer._pairs) < 200_000
        if n < len(letters):
            # the library takes the square of a piece's length: compare the part it can do
            short = letters[:3000].encode()
            assert list(array.array("I", transducer.encode(short))) == library._core_bpe.encode_single_piece(short)
    assert took[1] < 12 * took[0]
    assert b"".join(transducer.bytes_of[i] for i in array.array("I", ids)) == letters.encode()
    pieces = bpe._Pieces(transducer, 100)
    assert pieces[letters[:2000]] == pieces[letters[:2000]] and not pieces


def test_contexts_hold_two_words_of_any_length():
    long = "w" * 5000
    text = f"{long} tel: 0151-12345 {long} {long} x1 a  b y2"
    found = {value: contexts for _, _, _, value, contexts in pii_bootstrap.slots(text, [])}
    assert found["x1"] == [" ".join([pii_bootstrap._short(long)] * 2)] and found["y2"] == ["a b"]
    assert found["0151-12345"] == [f"{pii_bootstrap._short(long)} tel:", "tel:"]
    giant = "7" + "q" * 2_000_000
    ((_, end, _, value, _),) = pii_bootstrap.slots(f"is it {giant}", [])
    assert end == 6 + len(giant) and len(value) < 100


def test_many_spans_are_passed_in_proportion():
    took = []
    for n in (5_000, 20_000):
        text = " ".join(f"mail a{i}@b.cc or id{i}" for i in range(n))
        base = pii_bootstrap.base_spans(text)
        begin = time.perf_counter()
        found = pii_bootstrap.slots(text, base)
        took.append(time.perf_counter() - begin)
        assert sum(kind < 0 for _, _, kind, _, _ in found) == n
    assert took[1] < 8 * took[0] + 0.5
