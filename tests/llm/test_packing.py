import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazegrid.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


class Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at:at + n]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_pack_round_trip(bits, ids):
    ids = np.array(ids, dtype="<u4") & np.uint32(2**bits - 1)
    data = packing.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (packing.unpack(data, len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_file_random_access(bits, monkeypatch):
    monkeypatch.setattr(packing, "READ_BLOCKS", 2)
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n).astype("<u4") for n in (0, 1, 7, 8, 100, 3, 0, 33)]
    out = io.BytesIO()
    w = packing.Writer(out, bits, block=8)
    for i, ids in enumerate(docs):
        w.add(i if i != 3 else None, ids)
    w.close()
    r = packing.Reader(Memory(out.getvalue()))
    assert all((r.document(i) == ids).all() for i, ids in enumerate(docs))
    assert r.checksums().tolist() == [zlib.crc32(x.tobytes()) for x in docs] and r.known.tolist() == [i != 3 for i in range(8)]
    with pytest.raises(ValueError):
        packing.Reader(Memory(out.getvalue()[:-1]))


TEXTS = ["", "a<|endoftext|>b", "<|ENDOFTEXT|> X", "The river's Größe!! it's ÉCOLE l'été 12.5% x_y ... ,;. a\u00a0b\u2003c A\u0301", "don't.'s, \u0130stanbul ǅ ﬁ ΣΑΣ µ ª 你好,世界。 😀!", "x." * 50, "?!.", "end.\nNext,line"]


def test_words_encode_as_whole_texts():
    whole = Tokenizer.from_file(FILE)
    got = list(packing.by_words(FILE)([t.encode() for t in TEXTS]))
    assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abTé Öß'.,!?1 \n\t\u0301\u00a0<|#-ñ"), max_size=30))
def test_any_text_encodes_as_whole(text):
    if not hasattr(test_any_text_encodes_as_whole, "pair"):
        test_any_text_encodes_as_whole.pair = (packing.by_words(FILE), Tokenizer.from_file(FILE))
    encode, whole = test_any_text_encodes_as_whole.pair
    assert next(iter(encode([text.encode()]))).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_round_trip_through_files(edge_docs, edge_rows, no_docs):
    got = packing.packed_round_trip(edge_docs, FILE).collect()
    whole, start, want = Tokenizer.from_file(FILE), 0, []
    for r in sorted(edge_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert packing.packed_round_trip(no_docs, FILE).count() == 0
