"""Personal data against plain loops over Python's regular expressions."""

import hashlib
import re

from claimlattice.llm import personal_data, queries
from claimlattice.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


ODD = [
    None, "", "no data", "a@b.com_x@y.org", "a@b.c.d@e.f", "x" * 300_000, "a." * 100_000 + "@b.c", "1." * 50_000, "+1" + "-" * 50_000 + "2", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.001",
    "4111 1111-1111 1111", "4111111111111111 5555555555554444", "call +49 30 1234567, or +1 (269) 555-3296 4524132264652876 and", "é𝔸 me@x.org 𝔸 +4917012345678", "+1 2 3 +12345678 +1.2.3.4.5.6.7.8",
    "write to jane [at] mail [dot] com or bob at mail dot org", "token = 4111111111111112", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "(826) 555-4081 is local", "..@-. @@ a@b a@b. %@x.y--", "1-2-3-4 5 6  7",
]


def found(spark, rows):
    return personal_data.find_personal(spark, spark.createDataFrame(rows, "doc_id long, text string, spans int, _row string, kind string"))


def test_base_spans_and_odd_rows(spark):
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(ODD)] + [(None, "a@b.cc", 0, None, None)] * 2
    got = [(r["doc_id"], [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]]) for r in found(spark, rows).collect()]
    assert sorted(got, key=str) == sorted([(r[0], base(r[1])) for r in rows], key=str)


def test_added_spans(spark):
    """What stands next to other digits, or is written in words, is added; a token's digits are not."""
    filler = [(100 + i, f"mail a{i}@mail{i % 9}.example.com tel +1 (2{i % 10}4) 555-01{10 + i % 90} card 4111111111111111 ip 10.0.{i}.7 end", 0, "", "") for i in range(60)]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(ODD)] + filler
    added = {r["doc_id"]: {(s["kind"], ODD[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"] if not s["base"]} for r in found(spark, rows).collect() if r["doc_id"] < len(ODD)}
    assert added[12] == {("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")}
    assert added[11] == {("card", "4111111111111111"), ("card", "5555555555554444")}
    assert ("email", "jane [at] mail [dot] com") in added[15]
    assert added[16] == set() and added[2] == set()


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in queries.op12_personal_data(spark, sf).collect():
        spans = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_empty_table(spark):
    assert found(spark, []).collect() == []
