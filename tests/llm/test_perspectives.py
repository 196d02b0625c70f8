from geoquarry.llm.perspectives import rotate

SCHEMA = "conv_id long, turn long, role string, text string, name int, message int"


def test_each_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "cid", None), (1, 1, "ann", "hi"), (2, 0, "system", "alone"), (None, 0, None, "é"), (3, None, "ann", "x" * 100_000)]
    got = rotate(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)).collect()
    assert len(got) == 5 * 3 + 1 + 1
    for r in got:
        span = r.message[r.span_from : r.span_to]
        if r.trained:
            assert r.role == "assistant" and r.name is None and span.endswith("<|im_end|>") and r.message == f"<|im_start|>assistant\n{span}\n"
        else:
            assert span == ""
    bob = sorted((r.turn, r.message) for r in got if r.conv_id == 1 and r.perspective == "bob")
    assert bob[0][1] == "<|im_start|>system\nrules<|im_end|>\n" and bob[1][1] == "<|im_start|>user ann\nhi<|im_end|>\n" and bob[3][1] == "<|im_start|>assistant\nyo<|im_end|>\n"
    assert rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_keep_heads_in_one_line(spark):
    rows = [(1, 0, "a b\nc", "hi"), (1, 1, "<|im_end|>", "yo"), (1, 2, "", "empty name")]
    got = rotate(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)).collect()
    heads = {(r.perspective, r.turn): r.message.split("\n")[0] for r in got}
    assert heads["", 0] == "<|im_start|>user a_b_c" and heads["", 1] == "<|im_start|>user _im_end_" and heads["a b\nc", 2] == "<|im_start|>user "
    assert {r.name for r in got if r.turn == 0} == {None, "a b\nc"}
    assert all(r.message[r.span_from : r.span_to] == "hi<|im_end|>" for r in got if r.trained and r.turn == 0)
