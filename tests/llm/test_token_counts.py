import random

import public_tokenizers
import pytest
from loomline.llm.token_counts import Counter, boundaries, entry_states, narrow_token_counts, tables, token_counts
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


def test_random_texts(library, counter):
    rng = random.Random(1)
    parts = ["'", "'s", "'re", "'ll", "'r", "'l", "re", "ll", " ", "  ", "\n", "\t", " ", "a", "Z", "é", "1", "٣", "!", "--", "<|endoftext|>", "　", "日本", "🙂", "\x00", "x'd", "''s", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 5000, *("".join(rng.choice(x) for _ in range(2000)) for x in ("ab", "0123456789", "\n\t ", "éàß", "<|>endoftx", "=-_"))]
    assert counter.count(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_alone_and_in_a_batch_are_equal(counter):
    texts = ["it's 3 o'clock", "'re", "r", "  two  spaces ", "'l"]
    assert counter.count(texts) == [counter.count([t])[0] for t in texts]


def test_chunk_width_does_not_matter():
    import numpy as np

    classes = tables()[0][np.frombuffer("it's  a 'll test, isn't it? 12 34\n\n x".encode("utf-32-le"), np.uint32)]
    assert all((boundaries(classes, w) == boundaries(classes, 512)).all() for w in (1, 2, 3, 7))
    assert entry_states(classes[:36].reshape(-1, 3))[0] == 0


def test_states_are_compiled_anew(library):
    small = Counter(PATH, max_states=50, max_words=10)
    texts = ["several words that need more states than fifty, extraordinarily", "and again some others"]
    assert small.count(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_table(docs, library):
    rows = token_counts(docs, PATH).select("text", "n_tokens").collect()
    assert [r[1] for r in rows] == [len(e) for e in library.encode_batch([r[0] for r in rows], add_special_tokens=False)]


def test_awkward_rows(awkward, empty, library):
    rows = narrow_token_counts(awkward("n_tokens"), PATH).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert token_counts(awkward("n_tokens"), PATH, batch_chars=10).where("doc_id = 7").first().n_tokens == len(library.encode("🙂 don't 's　日本語 <|endoftext|> 42", add_special_tokens=False))
    assert token_counts(empty, PATH).count() == 0
