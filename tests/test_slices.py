"""What a step of a graph search holds as Python objects at once."""

import pyarrow as pa

from vecspan.operators import proximity


def test_beams_are_taken_in_slices():
    whole = pa.RecordBatch.from_arrays([pa.array(range(2 * proximity.BLOCK + 3))], names=["qid"])
    parts = list(proximity._sliced(iter([whole, whole.slice(0, 0), whole.slice(0, 5)])))
    assert [p.num_rows for p in parts] == [proximity.BLOCK, proximity.BLOCK, 3, 5]
    assert [q for p in parts for q in p.column(0).to_pylist()] == [*range(2 * proximity.BLOCK + 3), *range(5)]
