"""Entity spans against a plain loop."""

import random
import re

from claimlattice.operators import entities
from claimlattice.operators.entities import entity_spans


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spans_are_those_of_a_loop(spark):
    rng = random.Random(6)
    aliases = [("tsmc", "Taiwan Semi"), ("tsmc", "TSMC"), ("bank", "First Bank"), ("bank2", "First Bank of Ohm"), ("ohm", "ohm"), ("é", "Crédit Éclair"), ("x", None), (None, "nobody"), ("y", "--"), ("z", "a b c d e")]
    pool = ["taiwan", "semi", "Taiwn", "semis", "TSMC", "tsmcs", "first", "bank", "bnk", "of", "ohm", "Crédit", "credit", "éclair", "nobody", "a", "b"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(40)] + [(90, None), (91, ""), (7, "TSMC and TSMC")]
    forms = {(" ".join(w), len(w), e, a) for e, a in aliases if e and a and 0 < len(w := re.findall(r"[^\W_]+", a.lower())) <= 4}
    want = []
    for i, t in docs:
        words, free = list(re.finditer(r"[^\W_]+", t or "")), 0
        for at in range(len(words)):
            for n in range(4, 0, -1):
                if at < free or at + n > len(words):
                    continue
                said = " ".join(w[0].lower() for w in words[at : at + n])
                near = [(d, e, a) for f, m, e, a in forms if m == n and (d := edits(said, f)) <= (1 if len(f) >= 5 else 0)]
                if near:
                    d, e, a = min(near)
                    want.append((i, at, n, words[at].start(), words[at + n - 1].end(), said, e, a, d))
                    free = at + n
    got = entity_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(aliases, "entity string, alias string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_only_likely_places_become_rows(spark, monkeypatch):
    """Of 20,000 sequences those near an alias leave the scan, not all to meet the aliases later."""
    rng = random.Random(9)
    docs = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(100)) + " first bnk") for i in range(100)]
    written = {}
    real = entities.saver

    def watch(*a):
        save = real(*a)

        def seen(df, name):
            written[name] = save(df, name)
            return written[name]

        return seen

    monkeypatch.setattr(entities, "saver", watch)
    got = entity_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("bank", "First Bank")], "entity string, alias string"))
    assert got.filter("surface = 'first bnk' and place = 100 and distance = 1").count() == got.count() == 100
    assert written["places"].count() == 100
