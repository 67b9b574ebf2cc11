"""What a worker holds while it counts the tokens of a batch."""

from unittest import mock

import pyarrow as pa

from binscore.operators import tokens


def test_a_worker_holds_the_pieces_of_few_texts(spark):
    """10,000 texts in one batch: their pieces are never held together."""
    texts = pa.array(["a bb " * 200, None, "", "c"] * 2500)
    with mock.patch.object(pa, "array", side_effect=pa.array) as made:
        counts = tokens.count_tokens(tokens.WhitespaceTokenizer(), texts)
        held = [len(c.args[0]) for c in made.call_args_list if isinstance(c.args[0], list)]
    assert counts.to_pylist() == [400, None, 0, 1] * 2500
    assert 0 < max(held) <= tokens.HELD_BYTES
