"""Collapse and rendering of logged conversations against a plain version."""

import random

from tallyhouse.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(turns):
    logs = {}
    for i, (conv, turn, role, text) in enumerate(turns):
        logs.setdefault((conv, i if conv is None else 0), []).append((turn is not None, turn or 0, role or "", text or ""))
    logs = {c: [t[2:] for t in sorted(ts)] for c, ts in logs.items()}
    out = set()
    for own in logs.values():
        longer = any(len(other) > len(own) and other[: len(own)] == own for other in logs.values())
        equal = [c for (c, _), other in logs.items() if other == own and c is not None]
        if not longer:
            out.add((min(equal) if equal else None, len(own), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in own)))
    return sorted(out, key=repr)


def log():
    rng = random.Random(6)
    turns, full = [], [[(rng.choice(["user", "assistant"]), rng.choice("abcé") * rng.randint(0, 3)) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    for conv in range(300):
        own = rng.choice(full)
        for i, (role, text) in enumerate(own[: rng.randint(1, len(own))]):
            turns.append((conv, i * 10, role, text))
    turns += [(900, None, None, None), (900, 1, "user", None), (901, 1, "user", "long " * 50_000), (902, 1, "a", "b"), (902, 1, "a", "b"), (903, 1, "ab", ""), (904, 1, "a", "b")]
    lone = [(None, 1, "user", "no id"), (None, 2, "user", "no id"), (None, 2, "user", "another one"), (None, None, None, None), (None, 5, "ab", ""), (None, 1, "user", "long " * 50_000)]
    return turns + lone + [(950, 1, "system", "starts a"), (950, 2, "user", "log"), (None, 7, "system", "starts a")]


def test_equals_plain_version(table, rows):
    turns = log()
    assert rows(chat.rendered_conversations(table(SCHEMA, turns))) == plain(turns)


def test_template_and_empty_table(table):
    found = chat.rendered_conversations(table(SCHEMA, [(1, 1, "user", "hi")]), ("[", "] ", "\n")).collect()
    assert [tuple(r) for r in found] == [(1, 1, "[user] hi\n")]
    assert chat.rendered_conversations(table(SCHEMA, [])).collect() == []


def test_segments_make_the_conversations(table, rows):
    turns = log()
    whole = {r[0]: r for r in plain(turns) if r[0] is not None}
    found = rows(chat.rendered_segments(table(SCHEMA, turns), most=40), "conv_id", "segment", "n_turns", "text")
    texts = {}
    assert sorted(r for r in found if r[0] is None) == sorted((None, 1, 1, r[2]) for r in plain(turns) if r[0] is None)
    for conv, _, n_turns, text in sorted((r for r in found if r[0] is not None), key=lambda r: (r[0], r[1])):
        assert len(text.encode()) < 40 + max(len(f"<|{r or ''}|>\n{t or ''}<|end|>\n".encode()) for c, _, r, t in turns if c == conv)
        texts[conv] = (conv, n_turns, texts.get(conv, (0, 0, ""))[2] + text)
    assert texts == whole and len(found) > len(whole)


def test_a_long_conversation_lies_in_many_ranges(spark, table, rows):
    """Two fifths of the turns are one conversation, as many have none."""
    turns = [(conv, i, "user", f"turn {i % 7}") for conv in (None, 5) for i in range(400)] + [(5, 400, "user", "end")] + [(10 + i, 0, "user", f"other {i}") for i in range(200)]
    frame = table(SCHEMA, turns)
    ranges = chat.turn_ranges(chat.stored_turns(frame)).collect()
    assert len([r for r in ranges if r.conv_id == 5]) > 1 and not [r for r in ranges if r.conv_id is None]
    assert rows(chat.rendered_conversations(frame)) == plain(turns)
