import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from deckloom.llm.text import shingle_hashes, word_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\t\x0b\x1cé 日", max_size=20)), max_size=8)


def words(text):
    return (text or "").encode().lower().split()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_shingles_as_plain_python(texts):
    hashes, counts = word_hashes(pa.array(texts, pa.string()))
    plain = [words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in plain]
    names: dict = {}
    for word, h in zip([w for own in plain for w in own], hashes.tolist(), strict=True):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    _, sizes = shingle_hashes(hashes, counts, 3)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()) for w in plain]
    assert sizes.tolist() == [len(s) for s in sets]


def test_slices_of_arrow_columns():
    column = pa.array(["zero", None, "a b", "", "A B c"]).slice(2)
    hashes, counts = word_hashes(column)
    assert counts.tolist() == [2, 0, 3] and hashes[:2].tolist() == hashes[2:4].tolist()
