"""Conversation repair and prefix trie against SQL, on odd and on skewed rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from claimlattice.llm import conversation_repair, prefix_trie, queries

ROWS = "conv_id long, turn long, role string, text string"


def odd_rows():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "", " \n", None, "Why?  ", "Wait!\n", "é .", "x" * 50_000]
    rows = [(c, rng.choice([None, *range(7)]), rng.choice(roles), rng.choice(texts)) for c in (0, 1, 2, 5, 6, 7, 11, None) for _ in range(12)]
    # Equal conversations, repeated rows, a conversation of a third of all rows, and ids far apart.
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(20, 60) for t in range(6)]
    rows += [(8, 1, "user", "Again.")] * 40
    rows += [(9, t, rng.choice(roles[:3]), rng.choice(["Go on.", "Well", f"Turn {t}."])) for t in range(400)]
    return rows + [(2**40, 2**40, "user", "Far."), (2**40, 0, "system", "Early.")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    rows = spark.createDataFrame(odd_rows(), ROWS).withColumn("role_of", F.lit(1)).withColumn("_at", F.lit("clash"))
    rows.repartition(3).write.parquet(f"{at}/conversations.parquet")
    return str(at)


def both(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))), sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_prefix_trie"])
def test_odd_rows(spark, folder, name):
    ours, theirs = both(spark, folder, name)
    assert ours == theirs


def test_short_segments_chain_alike(spark, folder, monkeypatch):
    """Segments of 2 turns: every conversation is chained from several."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", 1)
    monkeypatch.setattr(conversation_repair, "BATCH_ROWS", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    for name in ("op11_conversation_repair", "op13_prefix_trie"):
        ours, theirs = both(spark, folder, name)
        assert ours == theirs


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_prefix_trie"])
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).collect() == []


def test_repair_by_brute_force():
    """Every way to edit up to four turns, with up to two insertions in each gap."""
    import itertools
    import re

    costs = conversation_repair.Costs()
    form = re.compile(r"(s?(ua)+)?$")

    def cheapest(turns):
        found = []
        ways = [[("D", "", 4)] + ([] if gone else [("K", i, 3 * cut)] + [("R", r, 3 + 3 * cut) for r in "ua"]) for i, gone, cut in turns]
        gaps = [("", 0), *[(x, 1) for x in "ua"], ("ua", 2), ("au", 2)]
        for edits in itertools.product(*ways):
            for more in itertools.product(gaps, repeat=len(turns) + 1):
                out = more[0][0] + "".join(e[1] + g[0] for e, g in zip(edits, more[1:]))
                if form.match(out):
                    audit = "I" * more[0][1] + "".join(e[0] + "I" * g[1] for e, g in zip(edits, more[1:]))
                    found.append((sum(e[2] for e in edits) + 3 * sum(g[1] for g in more), audit))
        return min(found)

    rng = random.Random(3)
    opening, moves = conversation_repair.openings(costs), conversation_repair.moves(costs)
    for _ in range(60):
        turns = [(rng.choice("sua-"), rng.random() < 0.3, rng.random() < 0.3) for _ in range(rng.randint(1, 3))]
        turns = [(i, gone, cut and not gone) for i, gone, cut in turns]
        states = {t: (cost, audit) for s, t, cost, audit in opening if s == 0}
        for turn in turns:
            after = {}
            for s, i, gone, cut, t, cost, audit in moves:
                if (i, gone, cut) == turn and s in states:
                    new = (states[s][0] + cost, states[s][1] + audit)
                    after[t] = min(after.get(t, new), new)
            states = after
        assert min(states[s] for s in conversation_repair.ENDS if s in states) == cheapest(turns)
