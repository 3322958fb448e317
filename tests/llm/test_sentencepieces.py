"""Encoding and decoding against the library, on texts, on hostile strings and on random ids."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import sentencepiece
from loomline.llm import sentencepieces
from loomline.llm.queries import QUERIES
from loomline.llm.sentencepieces import Pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


def ids_of(model, text):
    return array("i", model.encode(text)).tolist()


def test_hostile_texts(library, model):
    rng = random.Random(13)
    known = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = ["", " ", " " * 1000, "x" * 5000, "aaaaaaa" * 99, "═" * 31, "▁▁ ▁x", "\0", "<s> <0x41> </s>", "日本語テキスト" * 50, "🙂🙂é", "퟿\U0010ffff", "\r\n\t　"]
    texts += ["".join(rng.choice("ab  thein▁\n\t.0123日本é🙂ßxX═") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randint(1, 8))).replace("▁", rng.choice((" ", "▁", ""))) for _ in range(3000)]
    for t in texts:
        assert ids_of(model, t) == library.encode(t)
        assert model.decode(library.encode(t)) == library.decode(library.encode(t))


def test_backtracking_and_bounded_memory(library):
    """Stores that are cleared all the time change nothing, and positions fail where the longest piece leads astray."""
    small = Pieces(PATH, max_stretches=3, max_pairs=3)
    rng = random.Random(3)
    astray = 0
    for _ in range(300):
        t = "".join(rng.choice("thein ") for _ in range(60))
        assert ids_of(small, t) == library.encode(t)
        words = ["▁" + w for w in t.split()]
        astray += any(small.split(w)[0] != max((w[:n] for n in range(1, len(w) + 1) if w[:n] in small.ids), key=len) for w in words)
    assert astray


def test_pieces_compatible_only_if_remerging_keeps_them(model):
    assert not model.fits("▁", "t") and model.fits("", "▁the") and model.merged("▁the") == ["▁the"]


def test_random_ids_decode_alike(library, model):
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.choice((rng.randint(0, 300), rng.randint(0, 31999), 259, 28705)) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)
    assert model.decode(model.known([None, 40_000, -1])) == " ⁇  ⁇ "


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("extra", ["ids", "_ids", "_text", "decoded"])
def test_awkward_rows(awkward, empty, library, extra):
    df = awkward(extra)
    coded = sentencepieces.encode(df, PATH, into="codes").collect()
    assert len(coded) == 9 and all(r.codes == library.encode(r.text or "") for r in coded) and extra in coded[0].asDict()
    assert {(r.doc_id, r.n_tokens) for r in sentencepieces.round_trip(df, PATH).collect()} == {(r.doc_id, len(library.encode(r.text or ""))) for r in coded}
    assert sentencepieces.round_trip(empty, PATH).count() == 0


def test_decode_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 264]), (4, [264])], "k int, ids array<int>")
    assert [r.decoded for r in sentencepieces.decode(df, PATH).orderBy("k").collect()] == ["", "", "a", "a"]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PATH, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="only merge-type"):
        Pieces(str(tmp_path / "other.model"))
