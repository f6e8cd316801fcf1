import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aqengine.llm import tokens
from aqengine.llm.common import shared_path

from .conftest import ODD, frame, words


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def want(rows, tokenizer):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, tokenizer):
    rows = [(i * 3 % 101, words(i, 1 + i % 50) + ("\n\n  x\t y" if i % 3 else " it's <|endoftext|> 12,5€ ")) for i in range(101)]
    docs = frame(spark, [(i, t, "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i, t in rows]).repartition(5)
    got = [tuple(r) for r in tokens.round_trip(docs).orderBy("start").collect()]
    assert got == want(rows, tokenizer)


def test_odd_rows_and_ids(spark, odd, none, tokenizer):
    got = [tuple(r) for r in tokens.round_trip(odd).orderBy("start").collect()]
    assert got == want([(r[0], r[1]) for r in ODD], tokenizer)
    assert tokens.round_trip(none).collect() == []
    path = shared_path(spark, "ids")
    tokens.write_ids(odd.filter("doc_id = 5"), path)
    text = odd.filter("doc_id = 5").first().text
    assert tokenizer.decode(tokens.read_ids(spark, path, texts=True).first().ids[:-1]) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab1'.s \n\t\x0b\x1c\x85\xa0\u2003\u3000é×ƒ—", "<|endoftext|>", ", ", "  ", "\n\n", "\r\n", "it's ", "ab", " é.", "\nab", " 12,5 "]), max_size=30).map("".join))
def test_pieces_give_the_same_ids(text):
    enc = tokens.encoder(tokens.default_tokenizer())
    assert enc.cuts
    for kept in (0, 4, 1000):
        tokens.KEPT = kept
        got = enc(pa.array([text, None, "a b.", text]))
        want = [enc.whole(t).tolist() for t in (text, "", "a b.", text)]
        assert [x.tolist() for x in got] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_packing(values):
    control, data = tokens.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tokens.unpack(control, data, len(values)).tolist() == values


def test_rows_of_one_doc_id_are_dealt_out(spark, tokenizer):
    rows = [(7, f"text {i}", "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(400)] + [(None, f"none {i}", "en", "s", 0, 0.0, 0, 0, 0, 0, "") for i in range(40)]
    path = shared_path(spark, "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_ids(frame(spark, rows).repartition(4), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokens.read_ids(spark, path, texts=True).orderBy("start").collect()
    assert [r.start for r in got] == [sum(len(x.ids) for x in got[:i]) for i in range(len(got))]
    assert sorted(tokenizer.decode(r.ids[:-1]) for r in got) == sorted(r[1] for r in rows)
    assert [r.doc_id for r in got] == [None] * 40 + [7] * 400
    assert spark.read.parquet(f"{path}/ids").select("shard").distinct().count() > 1
