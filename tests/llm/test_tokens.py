import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, token_files, tokens
from tidemark.llm.common import new_path

from .cases import documents, rows


@lru_cache(maxsize=None)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


@lru_cache(maxsize=None)
def plain_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB é'.,!?1 \n\t\r\x0b\x1c\xa0 z—s'll"), max_size=30))
def test_encoder_equals_the_library(text):
    encode = tokens.encoder(tokens.vocabulary_path())
    assert np.frombuffer(encode([text])[0], encode.type).tolist() == plain_ids(text)


def test_encoder_takes_special_strings_as_the_library_and_keeps_a_bounded_cache():
    encode = tokens.Encoder(tokens.vocabulary_path(), kept=3)
    assert np.frombuffer(encode(["a <|endoftext|> b"])[0], encode.type).tolist() == [64, 220, 50256, 275]
    for text in ("one two three four five", "<|endoftext|> it's, it's.", "one two", "two, three two five", "", "one one one", "six"):
        assert np.frombuffer(encode([text])[0], encode.type).tolist() == plain_ids(text)


def test_pieces_hold_each_id_once(spark):
    pieces = packing.pack(documents(spark), length=64, digest=True).collect()
    by_row = defaultdict(list)
    for r in pieces:
        by_row[r.doc_id].append(r)
    want = Counter()
    for doc, text, *_ in rows():
        ids = [*plain_ids(text), packing.END_ID]
        want[doc, len(ids)] += 1
    for r in pieces:
        assert 0 < r.length <= 64 and 0 <= r.offset and r.offset + r.length <= 64
    ends = defaultdict(list)
    for r in pieces:
        ends[r.sequence_id].append((r.offset, r.length))
    for k, own in ends.items():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(n for _, n in own) == 64 or k == max(ends)
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    texts = {doc: text for doc, text, *_ in rows() if doc is not None}
    for r in pieces:
        if r.doc_id is not None:
            ids = [*plain_ids(texts[r.doc_id]), packing.END_ID]
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])


def test_sequences_join_edges_of_tasks(spark):
    docs = documents(spark).repartition(7)
    pieces = packing.pack(docs, length=128)
    out = packing.sequences(pieces, 128).collect()
    assert sum(r.n_tokens for r in out) == sum(len(plain_ids(t)) + 1 for _, t, *_ in rows())
    assert all(len(r.ids) == 2 * r.n_tokens for r in out)
    assert sum(r.n_tokens < 128 for r in out) <= 1 and len({r.sequence_id for r in out}) == len(out)


def test_sequences_hold_the_ids_in_order(spark):
    data = [(k, t, "en", "s", 1, *["z"] * 10) for k, t in enumerate(["some words of a text " * 9, None, "", "more <|endoftext|> words"])]
    docs = documents(spark, data).repartition(3)
    pieces = packing.pack(docs, length=16)
    placed = {(r.sequence_id, r.offset + k): i for r in pieces.collect() for k, i in enumerate(np.frombuffer(r.ids, "<u2").tolist())}
    joined = {(r.sequence_id, k): i for r in packing.sequences(pieces, 16).collect() for k, i in enumerate(np.frombuffer(r.ids, "<u2").tolist())}
    for r in packing.with_sequence_digest(pieces, 16).collect():
        assert r.sequence_crc32 == crc([i for (k, _), i in sorted(placed.items()) if k == r.sequence_id])
    assert placed == joined and len(placed) == sum(len(plain_ids(t)) + 1 for _, t, *_ in data)


def test_many_rows_without_a_key_are_spread(spark):
    folder = new_path(spark, "ids")
    docs = spark.range(4000).selectExpr("case when id % 2 = 0 then id end as doc_id", "concat('text ', id) as text")
    files = token_files.write_files(docs, folder, file_ids=10**9)
    back = token_files.read_files(spark, folder, files).orderBy("start").collect()
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()
    assert [r.doc_id for r in back] == [None] * 2000 + list(range(0, 4000, 2))
    assert files.table.where("first_key = -9223372036854775808").count() > 1


def test_empty_table_and_no_tokens(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    folder = new_path(spark, "none")
    assert token_files.read_files(spark, folder, token_files.write_files(documents(spark, []), folder)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_ranks_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = token_files.encode_ranks(ranks)
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == values


def test_files_round_trip_in_order_of_keys(spark):
    folder = new_path(spark, "ids")
    back = token_files.read_files(spark, folder, token_files.write_files(documents(spark), folder, file_ids=500)).orderBy("start").collect()
    want = Counter((doc, tuple([*plain_ids(t), token_files.END_ID])) for doc, t, *_ in rows())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back) == want
    keys = [token_files.NULL_KEY if r.doc_id is None else r.doc_id for r in back]
    assert keys == sorted(keys)
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()


def test_damaged_file_is_refused():
    whole = token_files.file_bytes([1], [3], np.array([1, 2, 300], np.uint32))
    assert token_files.parse_file(whole)[2].tolist() == [1, 2, 300]
    with pytest.raises(ValueError):
        token_files.parse_file(whole[:-1])
