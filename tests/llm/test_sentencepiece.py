import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.llm import sentencepiece_bpe as sp
from provena.llm.queries import tokenizer_path

library = pytest.importorskip("sentencepiece")
OWN = sp.PieceModel(sp.load_model(tokenizer_path()))
LIB = library.SentencePieceProcessor(model_file=tokenizer_path())


def check(text):
    want = LIB.encode(text, add_bos=True, add_eos=True)
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIB.decode(want)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a\nb\tc\r\n", "▁a ▁", "\x00", "<s> </s> <unk> <0x41>", "😀é́中文", "\u3000x\xa0", " " * 77, "a" * 3000, "the " * 2000, "\ufeffx", "x" + " " * 33 + "y"])
def test_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ▁\n\tabcdenrstühé.,!<>0x中😀́"), max_size=60))
def test_mixed_texts(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    check(text)


def test_pairs_equal_direct_merging():
    rng = np.random.default_rng(0)
    ids = [i for i in OWN.id_of.values() if OWN.pieces[i].strip(sp.MARK) and sp.MARK not in OWN.pieces[i] and (len(OWN.pieces[i]) == 1 or i in OWN.last_merge)]
    for a, b in rng.choice(ids, (4000, 2)):
        a, b = int(a), int(b)
        assert OWN.compatible(a, b) == (OWN.merge(OWN.pieces[a] + OWN.pieces[b]) == [a, b])


def test_documents(spark):
    rows = [(1, "some words, some more", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "some words, some more", "x"), (4, "word " * 60000, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sp.encode_documents(d, sp.load_model(tokenizer_path()), with_ids=True).collect()
    assert len(got) == len(rows)
    for r, (doc, text, _) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(rows, key=lambda r: (str(r[0]), len(r[1] or ""))), strict=True):
        want = LIB.encode(text or "", add_bos=True, add_eos=True)
        assert r.doc_id == doc and r.n_tokens == len(want) and list(r.ids) == want
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(want).encode()).hexdigest()
    assert sp.encode_documents(d.limit(0), sp.load_model(tokenizer_path())).count() == 0
