import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from inkfold.llm import sentence_pieces
from inkfold.llm.queries import PIECES

MODEL = public_tokenizers.path(PIECES)
HARD = [
    "", " ", "  a  b ", "\n\n", "a\n b\n\n  c", "▁x ▁▁ y", " x\t y", "日本語 テスト😀😀", "a▁ b", "▁", "12 345",
    "\x00a", "é fi ﬁ Ａ", "<s> </s> <unk> <0x41>", " \n \n", "a" * 3000 + " b", "▁▁▁▁▁a    b", "²., m².",
]


def _random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("ab ▁\n\t é日😀1<>.,²") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = sentence_pieces.Codec(MODEL)
    texts = HARD + _random_texts(2000)
    encoded = codec.encode([t.encode() for t in texts])
    assert [e[0].tolist() for e in encoded] == library.encode(texts)
    assert codec.decode([e[0] for e in encoded]) == [library.decode(i) if i else "" for i in library.encode(texts)]


def test_spans_give_back_each_piece():
    codec = sentence_pieces.Codec(MODEL)
    for text in HARD:
        ((ids, starts, ends),) = codec.encode([text.encode()])
        got = b"".join(text.encode()[s:e] for s, e in zip(starts, ends, strict=True))
        assert got == text.encode()
        for i, s, e in zip(ids.tolist(), starts, ends, strict=True):
            if not codec.library.is_byte(i):
                piece = codec.library.id_to_piece(i).replace("▁", " ")
                assert text.encode()[s:e].decode().replace("▁", " ") in (piece, piece[1:])


def _trie_blob(pairs):
    """A compiled map for one-byte keys: root children at 256, one leaf for each key."""
    texts, units = b"", [0] * 1024
    units[0] = 256 << 10
    for n, (key, value) in enumerate(sorted(pairs.items())):
        node = 256 ^ key
        leaf = 512 + n
        units[node] = ((node ^ leaf) << 10) | 1 << 8 | key
        units[leaf] = len(texts) | 1 << 31
        texts += value + b"\0"
    import struct

    return struct.pack(f"<I{len(units)}I", len(units) * 4, *units) + texts


@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("mapped", [False, True])
def test_map_and_trimming_follow_the_library(trim, mapped):
    """Models with a compiled map and with blanks trimmed, against the library's own ids."""
    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = trim
    if mapped:
        model.normalizer_spec.precompiled_charsmap = _trie_blob({ord("A"): b"a", ord("\t"): b" ", ord("Q"): b"", ord("W"): b"the "})
    path_model = model.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=path_model)
    codec = sentence_pieces.Codec.__new__(sentence_pieces.Codec)
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(path_model)
        f.flush()
        codec.__init__(f.name)
    texts = ["A b", " A  Q ", "WW a", "\t\tA\t", "QQ", "  ", "AWA Q x", "日 A\n  W"] + _random_texts(300, 5)
    encoded = codec.encode([t.encode() for t in texts])
    for text, (ids, starts, ends) in zip(texts, encoded, strict=True):
        assert ids.tolist() == library.encode(text), text
        assert (starts <= ends).all() and (ends <= len(text.encode())).all()


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None), (None, "c", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentence_pieces.encode(df, MODEL)
    assert out.columns == ["doc_id", "text", "ids", "starts", "ends", "decoded"]
    got = sorted((r.doc_id or 0, r.text or "", len(r.ids), r.decoded) for r in out.collect())
    assert [g[3] for g in got] == [g[1] for g in got]
    back = sentence_pieces.decode(out.drop("decoded"), MODEL)
    assert sorted(r.decoded for r in back.collect()) == sorted(g[1] for g in got)
    assert sentence_pieces.encode(df.limit(0), MODEL).count() == 0
    summary = sentence_pieces.encode_summary(df, MODEL, keep=["doc_id"])
    assert all(r.spans_cover for r in summary.collect())
