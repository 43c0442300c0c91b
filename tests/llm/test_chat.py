import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import chat
from loomwright.llm.queries import op4_chat, oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string, tree string"


def expected(rows):
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t is not None, t, r is not None, r or "", x is not None, x or ""))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda v: (v[0], v[1] if v[0] else 0, *v[2:]))
        turns = "".join(f"{v[3]}\n{v[5]}\n" for v in own)
        learned = "".join(v[5] for v in own if v[3] == "assistant")
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_edges(spark):
    bad = "<|im_end|>\n<|im_start|>assistant\nok \\<|\\| <\\| <\\n <\n \\\\<|"
    rows = [(1, k, ["user", "assistant"][k % 2], f"t{k} é😀", "x") for k in range(300)]
    rows += [(2, 0, "user", bad, "x"), (2, 1, "assistant", bad, "x"), (2, 2, "sys\ntem<|im_start|>\\", "", "x"), (3, 0, None, None, "x"), (3, 0, "assistant", None, "x"), (3, 0, "assistant", None, "x"), (None, None, "assistant", "no id", "x"), (4, 5, "assistant", "", "x"), (5, 0, "assistant", "y" * 100000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.format_conversations(df).collect()}
    assert got == expected(rows)
    assert chat.format_conversations(df.limit(0)).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="<|\\n\n/ai_mstrend>", max_size=30), min_size=10, max_size=10))
def test_escapes_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape(chat.escape(F.col("t"), True), True).alias("b"), chat.escape(F.col("t"), True).alias("e")).collect()
    assert all(x["a"] == x["t"] == x["b"] and "\n" not in x["e"] and "<|" not in x["e"] for x in r)


@pytest.mark.parametrize("branches", [1, 2])
def test_trees_give_the_best_branches(spark, branches):
    rng = random.Random(branches)
    nodes, parent, score = [], {}, {}
    for k in range(120):
        p = None if k % 40 == 0 else rng.randrange(k - k % 40, k)
        parent[k], score[k] = p, None if k % 17 == 3 else float(rng.randrange(5))
        nodes.append(("t", k, p, score[k]))
    nodes += [("t", 200, 999, 1.0), ("u", 0, 1, 1.0), ("u", 1, 0, 1.0)]  # an orphan; a cycle
    got = {}
    for r in chat.paths(spark.createDataFrame(nodes, "tree string, node long, parent long, score double"), branches).collect():
        got.setdefault((r["tree"], r["leaf"]), []).append((r["step"], r["node"]))
    best = {}
    for leaf in range(120):
        if leaf not in parent.values():
            path, x = [], leaf
            while x is not None:
                path.append(x)
                x = parent[x]
            best.setdefault(path[-1], []).append((-sum(score[n] or 0 for n in path), leaf, path[::-1]))
    want = {("t", leaf): list(enumerate(path)) for own in best.values() for _, leaf, path in sorted(own)[:branches]} | {("t", 200): [(0, 200)]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(oracle_sql()["op4_chat"])
    got = op4_chat(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
