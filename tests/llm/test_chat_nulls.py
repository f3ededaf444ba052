"""A null conversation is one conversation."""

from tidecube.llm import chat


def test_null_conversation_is_kept(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (None, 2, "user", "more"), (3, 0, "user", "x"), (3, 1, "assistant", "y")]
    own = chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_trees(own)).collect()}
    assert got == {None: [("user", "q"), ("assistant", "a"), ("user", "more")], 3: [("user", "x"), ("assistant", "y")]}
    assert sorted((r.tree or 0, r.position) for r in chat.reply_paths(own).collect()) == [(0, 0), (0, 1), (0, 2), (3, 0), (3, 1)]
