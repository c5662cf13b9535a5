import pyarrow as pa
import pytest

from lakeweave.llm import text as t


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("others", [[], ["ab " * 400_000]])
def test_a_lone_short_text_in_its_slice(n, others):
    data, offsets = t.string_buffers(pa.array([" ".join("abcde"[:n]), *others]))
    parts = list(t.slices(offsets))
    sets = [s for i, j in parts for s in t.shingle_sets(t.words_of(data, offsets[i : j + 1], t.WHITE), 5)]
    assert len(parts) == 1 + len(others) and [len(s) for s in sets] == [1] * len(parts)
