"""Encoding with spans against the library's own whole-text encoding."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from lodestrata.llm import sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " a", "  a  b ", "▁", "▁a▁ ▁", "a\u0000b\n\tc", "<s> </s>", "☃𝄞 ﻿", "ｱﾞ ㍿  é é", "¨x ¨", "\x1f0", " \x1f a\u200b ", "日本語のテキスト " * 30, "x" * 500, "Ünïcode wörds, the same the same the"]


def spec_of(rule: str | None, **settings_) -> bytes:
    """The model's file with another normaliser."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    if rule:
        other = sentencepiece_model_pb2.ModelProto()
        other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
        model.normalizer_spec.name = rule
    for k, v in settings_.items():
        setattr(model.normalizer_spec, k, v)
    return model.SerializeToString()


BLOBS = [spec_of(None), spec_of(None, add_dummy_prefix=False), spec_of("nmt_nfkc", remove_extra_whitespaces=True), spec_of("nfkc_cf"), spec_of("nmt_nfkc_cf", remove_extra_whitespaces=True, add_dummy_prefix=False), spec_of("nmt_nfkc", escape_whitespaces=False)]
MODELS = [(sentence_pieces.Pieces(b), sentencepiece.SentencePieceProcessor(model_proto=b)) for b in BLOBS]


def same(model, library, texts):
    for text, (ids, begins, ends) in zip(texts, model.encode(texts)):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == library.encode(text) == [p.id for p in want], repr(text)
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], repr(text)
        assert model.decode([ids.tolist()]) == [library.decode(ids.tolist())]


@pytest.mark.parametrize("k", range(len(MODELS)))
def test_ids_and_spans_are_the_librarys(k):
    same(*MODELS[k], TEXTS)
    assert MODELS[k][0].by_length


@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n▁aeİßﬁ㍿ｱﾞ́　 ​﻿<s>1½☃𝄞"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=6), st.sampled_from(range(len(MODELS))))
@settings(max_examples=400, deadline=None)
def test_any_text(texts, k):
    same(*MODELS[k], texts)


def test_models_without_byte_pieces():
    """An unknown character is a piece without a length of its own."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(BLOBS[0])
    model.trainer_spec.byte_fallback = False
    for p in model.pieces:
        if p.type == sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE:
            p.type = sentencepiece_model_pb2.ModelProto.SentencePiece.UNUSED
    blob = model.SerializeToString()
    own = sentence_pieces.Pieces(blob)
    assert not own.by_length
    same(own, sentencepiece.SentencePieceProcessor(model_proto=blob), TEXTS)


def test_user_defined_symbols_are_refused():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(BLOBS[0])
    model.pieces.add(piece="[X]", score=0, type=sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED)
    with pytest.raises(ValueError):
        sentence_pieces.Pieces(model.SerializeToString())


def test_rows(spark):
    """Nulls, repeats, ties, clashing names and an empty table; decoding as a step of its own."""
    schema = "doc_id long, text string, ids string, decoded long"
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, "a", "y", 2), (3, "a", "y", 2), (99, "the end " * 20_000, "z", 0)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    library = MODELS[0][1]
    got = sentence_pieces.encode(docs, PATH, decoded=True)
    again = {str((r["doc_id"], r["ids"], r["again"])) for r in sentence_pieces.decode(got, PATH, name="again").collect()}
    found = got.collect()
    want = sorted(str((i, library.encode(t or ""), library.decode(library.encode(t or "")))) for i, t, _, _ in rows)
    assert sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in found) == want and again == set(want)
    assert all(r["covered_bytes"] == r["n_bytes"] for r in found)  # the identity drops nothing
    assert sentence_pieces.encode(docs.limit(0), PATH).count() == 0


def test_query(spark, sf):
    library = MODELS[0][1]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids)))
    got = sentence_pieces.op13_sentence_pieces(spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
