"""Words of small Latin letters go to the model itself and get the ids that the library gives their text."""

import numpy as np
import pyarrow as pa

from firmlens.llm import op4_tokens
from firmlens.llm.common import tokenizer_path

TEXTS = ["été père, größe; naïve ÿ ñandú.", "déjà!? vu-là l'été à 3÷4 ß", "Éclair İ ſt µm ªº 가 ﬁn", "", None]


def test_latin_words_need_no_library_pass():
    encoder = op4_tokens.Encoder(tokenizer_path(op4_tokens.MODEL))
    plain = [encoder._whole([t or ""])[0] for t in TEXTS]
    asked: list[str] = []
    whole = encoder._whole
    encoder._whole = lambda texts: asked.extend(texts) or whole(texts)
    ids, n = encoder.encode(pa.array(TEXTS))
    assert [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])] == plain
    words = {w for t in asked for w in t.split()}
    assert not words & {"été", "père", "größe", "naïve", "ñandú", "déjà", "là", "ß", "ÿ"}


def test_shards_give_their_ids_back():
    ids = np.random.default_rng(3).integers(0, 49_000, 70_000).astype(np.uint16)
    matrix, ends = op4_tokens.unpack(op4_tokens.pack(ids, np.array([0, 5, 70_000])))
    assert np.array_equal(matrix.ids(), ids) and ends.tolist() == [0, 5, 70_000]
    assert [matrix.access(i) for i in (0, 4_321, 69_999)] == ids[[0, 4_321, 69_999]].tolist()
