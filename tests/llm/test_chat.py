import hashlib

from pyspark.sql import functions as F

from gristmill.llm.chat import Tokens, escape, packed, parse, parts_of, read_back, read_ranks, unescape

RANKS = read_ranks("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\", "\\\\<", "", "a: b\n\n", "é\U0001f600", "x" * 9000]


def test_escapes_read_back():
    turns = [(r, t) for r in ("user", "assis:tant", "", "### x: y\\") for t in HARD]
    assert parse("".join("".join(parts_of(r, t)) for r, t in turns)) == turns
    assert all(unescape(escape(t)) == t for t in HARD)


def talks(spark):
    rows = [(c, i, r, t, "x") for c in range(6) for i, (r, t) in enumerate([("system", "same"), ("user", f"q{c % 2}"), ("assistant", HARD[c])])]
    rows += [(c, i, "user", t, "x") for c in (10, 11) for i, t in enumerate(HARD)]
    rows += [(20, None, None, None, "x"), (20, 1, "assistant", None, "x"), (None, 0, "user", "u", "x"), (30, 0, "user", "same", "x"), (30, 0, "user", "same", "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, TOKENS string")


def test_conversations_come_back(spark):
    rows, df = talks(spark)
    got = {r.conv_id: r for r in read_back(packed(df, RANKS), RANKS).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[conv].loss_chars == len(said) and got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len("".join(parts_of(r, t))) for _, r, t in turns)
    assert read_back(packed(df.limit(0), RANKS), RANKS).collect() == []


def test_stream_is_depth_first_and_attends_to_ancestors(spark):
    rows, df = talks(spark)
    stream = packed(df, RANKS)
    nodes = sorted(stream.nodes.collect(), key=lambda n: n.packed_start)
    assert nodes[0].packed_start == 0
    assert all(a.packed_end == b.packed_start for a, b in zip(nodes, nodes[1:]))
    assert all(len(n.tokens) == n.packed_end - n.packed_start == len(n.position_ids) for n in nodes)
    trees = [n.tree for n in nodes]
    assert sum(a != b for a, b in zip(trees, trees[1:])) == len(set(trees)) - 1
    flat = [t for n in nodes for t in n.tokens]
    coder = Tokens(RANKS)
    shared = 0
    for n in nodes:
        seen = [i for a in n.ancestors for i in range(a.start, a.end)]
        assert n.position_ids == list(range(len(seen), len(seen) + len(n.tokens)))
        assert all(a.end < b.start for a, b in zip(n.ancestors, n.ancestors[1:]))
        parse(coder.decode([flat[i] for i in seen] + list(n.tokens)))
        shared += len(n.ancestors) > 1
    assert shared  # some node's ancestors are not its neighbours
    assert stream.members.count() == len({r[0] for r in rows})
    assert stream.paths.groupBy("packed_start").count().agg(F.max("count")).first()[0] >= 2
