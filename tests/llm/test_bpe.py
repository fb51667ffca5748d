import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from railyard.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(library, text):
    own = bpe.codec(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " \n", "Hello the<|endoftext|> wörld ΑΣ 12 don't\x1cx", "<|startoftext|><|startoftext", "aaaaaaaaaaaa", "é é", "日本語です 𝒳𝒴", "x" * 5000, "I'LL we've 'D '''s", "a b c\u0085d", "İstanbul", "\x00\x7f﻿"])
def test_like_the_library(library, text):
    same(library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abctheinAB 's<|>endoftext.,12éß\n\t"), st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"])), max_size=60))
def test_random_texts(library, text):
    same(library, text)


def test_frame(spark, library):
    rows = [(1, None, "k"), (2, "", None), (3, "The thing", "k"), (3, "The thing", "k"), (None, "b " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest()[:4] and r.decoded) for r in out if (r.doc_id or 0) == 3] == [(3, 2, "the</w> thing</w>")] * 2
    assert sorted(r.n_tokens for r in out) == [0, 0, 2, 2, 3000]
    at_once = bpe.encode(df, PATH, decoded_col="decoded").collect()
    assert sorted((r.n_tokens, bytes(r.ids), r.decoded) for r in at_once) == sorted((r.n_tokens, bytes(r.ids), r.decoded) for r in out)
    assert bpe.encode(df.limit(0), PATH).count() == 0
