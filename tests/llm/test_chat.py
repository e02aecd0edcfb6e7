"""Preference pieces against a list version; odd rows."""

import random

from caseloom.llm import chat

SCHEMA = "pair_id long, rejected boolean, turn long, role string, text string, part string"


def test_pieces_and_rows(spark):
    r = random.Random(1)
    convs = {}
    for p in range(40):
        base = [("user" if i % 2 == 0 else "assistant", f"t{r.randrange(3)}") for i in range(r.randrange(0, 6))]
        for side in (False, True):
            tail = [("assistant", f"x{r.randrange(2)}"), ("user", "same")][:r.randrange(0, 3)]
            convs[p, side] = base[:r.randrange(len(base) + 1)] + tail if r.random() < .5 else base + tail
    rows = [(p, s, i, role, text, "clash") for (p, s), turns in convs.items()
            for i, (role, text) in enumerate(turns)]
    rows += rows[:7] + [(None, False, None, None, None, "c"), (99, True, 0, "assistant", "é" * 50_000, "c")]
    got = chat.assemble(chat.preference_pieces(spark.createDataFrame(rows, SCHEMA))).collect()
    seen = {x.pair_id: x for x in got}
    show = lambda turns: "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in turns)      # noqa: E731
    for p in range(40):
        a, b = convs[p, False], convs[p, True]
        if not a and not b:
            assert p not in seen
            continue
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        x = seen[p]
        assert (x.prompt, x.chosen, x.rejected) == (show(a[:k]), show(a[k:]), show(b[k:]))
        for turns, text, spans in ((a[k:], x.chosen, x.chosen_spans), (b[k:], x.rejected, x.rejected_spans)):
            want = [t + "<|end|>\n" for role, t in turns if role == "assistant"]
            assert [text[s.start:s.start + s.length] for s in spans] == want
    assert seen[None].chosen == "<||>\n<|end|>\n" and len(seen[99].rejected) > 50_000
    assert chat.preference_pieces(spark.createDataFrame([], SCHEMA)).count() == 0
