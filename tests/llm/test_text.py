"""Word spans, hashes, in-step BPE, and the two tokenizers against their libraries."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from docframe.llm import piecebpe, queries
from docframe.llm.textbytes import hash_spans, slices, spans, text_bytes
from docframe.llm.wordbpe import WordBpe

ODD = ["", " ", "\n", "it's we're he'll 'sure ''s don't DON'T", "ÉCOLE ª²½ x²", "日本 ok", "a<|endoftext|>b", "İstanbul ΣΑΣ ß", "a" * 400 + " " + "xyz'" * 90, "‘curly’ “q” – €5 3.14 a_b", "é é", "\x00a", "😀 x",
       " a  b ", "▁a▁▁b", "x\n\ny \n z", "<s> </s> <unk> <0x0A>", "x" * 300 + "\n" + "y" * 300 + "  " + "z" * 300, "tab\tx\x0b\x0c\r\n"]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té日", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_spans_are_the_words(texts):
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    begin, stop, row = spans(buf, offsets)
    got = [[] for _ in texts]
    for a, b, r in zip(begin, stop, row, strict=True):
        got[r].append(bytes(buf[a:b]))
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    words = [w for g in got for w in g]
    hashes = hash_spans(buf, begin, stop)
    assert len(set(hashes.tolist())) == len(set(words))
    assert {w: h for w, h in zip(words, hashes.tolist(), strict=True)} == dict(zip(words, hashes.tolist(), strict=True))


def test_slices_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 101, 102])
    assert list(slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]


@given(st.lists(st.text(alphabet="ab'sreé 1.,\n日", max_size=40), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_word_bpe_is_the_librarys(texts):
    check_word_bpe(texts)


def test_word_bpe_on_odd_texts():
    check_word_bpe(ODD)


WORDS = WordBpe(public_tokenizers.path("word_bpe_49k.json"), cache=50)  # so small that it starts anew often
WORDS_LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_word_bpe(texts):
    ids, counts = WORDS.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for i, want in enumerate(WORDS_LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] - counts[i] : ends[i]].tolist() == want.ids, texts[i]


PIECES = piecebpe.PieceBpe(public_tokenizers.path("piece_bpe_32k.model"), cache=50)
PIECES_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@given(st.lists(st.text(alphabet="ab the\n▁é1日", max_size=40), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_pieces_are_the_librarys(texts):
    check_pieces(texts)


def test_pieces_of_odd_texts():
    check_pieces(ODD)


def check_pieces(texts):
    buf, offsets = text_bytes(pa.array(texts))
    ids, counts = PIECES.encode_slice(buf, offsets)
    data, lengths = PIECES.decode_bytes(ids, counts)
    ends, stops = np.cumsum(counts), np.cumsum(lengths)
    for i, text in enumerate(texts):
        own = ids[ends[i] - counts[i] : ends[i]]
        assert own.tolist() == PIECES_LIBRARY.encode(text), text
        assert bytes(data[stops[i] - lengths[i] : stops[i]]).decode() == PIECES_LIBRARY.decode(own.tolist())
        begins, stop = PIECES.spans_of(text.encode(), own)
        assert (begins[1:] == stop[:-1]).all()  # the spans follow one another and cover the text
        if len(own):
            assert begins[0] == 0 and stop[-1] == len(text.encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_longest_prefix_normalisation(rule, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = piecebpe.Normalizer(proto.normalizer_spec)
    for text in ["ＡＢＣ ｶﾞ ﬁ ① Ⅳ  x  ", "  ½ é　z", "Hello  World\n\nx", "", "   ", "Straße İ"]:
        normal, source = own(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(source) == len(normal) + 1 and source == sorted(source) and source[-1] <= len(text.encode())


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_ids_and_spans_come_from_own_normalisation(tmp_path, monkeypatch, rule, squeeze):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze).serialized_model_proto())
    proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
    path = tmp_path / "own.model"
    path.write_bytes(proto.SerializeToString())
    coder = piecebpe.PieceBpe(str(path))
    texts = [*ODD, "ＡＢＣ ｶﾞ ﬁ ① Ⅳ  x  ", "  ½ é　z", "Straße İ", "x" * 400]
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    want = [library.encode(t) for t in texts]
    if not coder.normalize.plain:
        monkeypatch.setattr(coder, "library", None)
    ids, counts, begins, ends = coder.encode_aligned(*text_bytes(pa.array(texts)))
    stops = np.cumsum(counts)
    for t, w, a, b in zip(texts, want, stops - counts, stops, strict=True):
        assert ids[a:b].tolist() == w, t
        assert [x.tolist() for x in (begins[a:b], ends[a:b])] == [x.tolist() for x in coder.spans_of(t.encode(), ids[a:b])], t


def test_query_has_the_spans_of_every_text(spark, tmp_path):
    texts = ["Hello  world", None, "", "a ▁é日😀"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans_sha256 for r in queries.op10_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        both = PIECES.spans_of((t or "").encode(), np.array(PIECES_LIBRARY.encode(t or ""), np.int64))
        assert got[i] == hashlib.sha256(np.stack(both, 1).astype("<i4").tobytes()).hexdigest()


def test_encode_operator(spark):
    rows = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "x")], "id long, text string, n_tokens string")
    out = piecebpe.encode(rows, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert [r.n_tokens for r in out] == [2, 0, 0, 2] and out[0].ids == PIECES_LIBRARY.encode("Hello world")
    assert out[0].begins == [0, 5] and out[0].ends == [5, 11] and out[0].decoded == "Hello world" and out[1].decoded == ""
    assert piecebpe.encode(rows.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("n", [94, 95, 96, 97, 98, 192, 193])
def test_long_words_at_the_border(n):
    """Words around the length from which the library encodes them give its ids too."""
    check_word_bpe(["a" * n, "é" * (n // 2) + "b" * (n % 2), "ab " + "the" * (n // 3) + "x" * (n % 3) + " end", "'" * n])


@pytest.mark.parametrize("n", [254, 255, 256, 257, 258, 512, 513])
def test_long_segments_at_the_border(n):
    check_pieces(["a" * n, "é" * n, " " + "ab" * (n // 2) + "c" * (n % 2), "x " + "the" * (n // 3) + "\n" + "日" * n, "▁" * n])
