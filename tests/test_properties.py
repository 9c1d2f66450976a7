"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import jsonrepair
from tidemark.operators import chunking

TEXT = st.lists(st.sampled_from(["word", "Two", ". ", "! ", "\n", "\n\n", ", ", "; ", " ", "  ", "é", "x" * 30]), max_size=200).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_chunks_are_lossless_and_bounded(text, size):
    found = chunking.chunks(text, size, 0)
    assert "".join(found) == (text if text.strip() else "")
    assert all(chunking.n_words(c) <= size for c in found)


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 20), st.integers(1, 10))
def test_overlap_only_adds_in_front(text, size, overlap):
    assert all(b.endswith(a) for a, b in zip(chunking.chunks(text, size, 0), chunking.chunks(text, size, overlap), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]"\\a:1, ', max_size=60))
def test_repair_never_fails_and_is_stable(text):
    for opening in "{[":
        found = jsonrepair.repaired(text, opening)
        assert found is None or jsonrepair.repaired(found, opening) == found
