from __future__ import annotations

from anbar.llm.chat import render

SCHEMA = "conv_id long, turn long, role string, text string, h1 string, place int"


def test_snapshots_copies_and_edges(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(c, i, r, t, "x", 0) for c, n in ((5, 3), (2, 2), (9, 1), (7, 3)) for i, (r, t) in enumerate(turns[:n])]
    rows += [(3, 0, "user", "b"), (3, 1, "assistant", "a")]  # the same texts in another order
    rows += [(4, 0, None, None), (None, 0, "user", "lost"), (6, None, "user", "late"), (6, 1, "user", "early")]
    rows += [(8, 0, "user", "twice"), (8, 0, "user", "twice"), (10, 0, "user", "x" * 200_000)]
    rows = [(*r, "x", 0)[:6] for r in rows]
    out = {r["conv_id"]: r for r in render(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {5, 3, 4, 6, 8, 10}
    assert (out[5]["n_turns"], out[5]["n_copies"]) == (3, 2)
    assert out[5]["text"].startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb")
    assert out[4]["text"] == "<|im_start|>unknown\n<|im_end|>\n"
    assert out[6]["text"].index("early") < out[6]["text"].index("late")
    assert out[8]["n_turns"] == 1
    assert render(spark.createDataFrame([], SCHEMA)).count() == 0
