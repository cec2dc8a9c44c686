"""Personal data: e-mail and IP addresses, card and phone numbers [native].

Base spans are what four patterns find and their checks (ranges of parts,
Luhn digits, counts of digits) pass.  Those patterns lose what stands next to
other digits, or is written in another way, so narrower and odder patterns
propose candidates besides.

Method: weak-supervision aggregation.  Labelers vote for or against each
candidate and base span, or abstain: by its form (regular expressions), by its
check, by gazetteers (issuers' prefixes, country codes, top domains, special
networks), by context (words before it) and by neighbouring data.  What a
labeler's votes are worth is not known, so expectation-maximisation estimates
it together with the chance that a span is real (a table of vote patterns,
whose size does not depend on the data, is all that it reads).  With these
chances as targets a logistic regression on votes and on form is trained, and
it decides which candidates are added.

Everything is DataFrame expressions: no Python runs on executors.  Matches get
their places from the lengths of what a text is split into, summed by a
window, so texts with any number of matches are fine; possessive patterns
keep each text's cost linear.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

KINDS = ("email", "ip", "card", "phone")

#: The four base patterns.  Runs are entered at their start only (or where the last match ended), and never given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Fewer than 16 digits never pass, so shorter runs are not even matched.
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: (name, kind, pattern) of candidates.
CANDIDATES = (
    ("phone_long", "phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){3}(?![0-9])"),
    ("phone_short", "phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2}(?![0-9])"),
    ("phone_local", "phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    ("card_run", "card", r"(?<![0-9])[0-9]{15,19}(?![0-9])"),
    ("card_groups", "card", r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    ("ip_quad", "ip", r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9])"),
    ("ip_six", "ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("email_brackets", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]{1,63}){1,5}"),
    ("email_words", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,5}"),
)

#: What a text must hold for any pattern, and for each: read once, so that most texts are not tried at all.
ANY = r"[0-9@]|[\[({]at[\])}]| dot "
NEEDS = {
    "at": "@", "plus": r"\+[0-9]", "quad": r"[0-9]\]?\.\[?[0-9]", "six": r":[0-9A-Fa-f]{1,4}:", "run": r"[0-9](?:[\x20-]?[0-9]){14}", "local": r"[0-9]{3}[ .-][0-9]{4}", "bracket": r"[\[({]at[\])}]", "dot": " dot ",
}
NEED = {
    "email": "at", "ip": "quad", "card": "run", "phone": "plus", "phone_long": "plus", "phone_short": "plus", "phone_local": "local", "card_run": "run", "card_groups": "run", "ip_quad": "quad", "ip_six": "six", "email_brackets": "bracket",
    "email_words": "dot",
}

#: Fixed values of the gazetteers and the context labeler.
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)"
COUNTRY_CODES = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])"
TOP_DOMAINS = r"\W(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch|it|nl|us|co)$"
SPECIAL_NETWORKS = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|correo|courriel|write to)\b", "ip": r"(?i)\b(ip|host|server|address|adresse|login from)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|karte|tarjeta|carte|credit|iban)\b", "phone": r"(?i)\b(tel|phone|call|fax|mobile|handy|whatsapp|tel[ée]fono|t[ée]l[ée]phone)\b",
}
NOT_PERSONAL = r"(?i)\b(token|password|secret|key|version|isbn|sha1|sha256|commit|hash|invoice|order|serial)\b"

LABELERS = ("form", "check", "gazetteer", "context", "neighbour")
#: Characters of context before a match, and what counts as a neighbour.
BEFORE, NEAR = 40, 3


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass: every second one from the right doubled, the sum divisible by 10."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = reduce(lambda a, b: a + b, [F.substring(doubled if i % 2 == 0 else padded, i, 1).cast("int") for i in range(1, 20)])
    return total % 10 == 0


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


PART = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def passes(kind: Column, hit: Column) -> Column:
    """The base check of a match."""
    digits = digits_of(hit)
    n = F.length(digits)
    return (
        F.when(kind == "email", True).when(kind == "ip", F.rlike(hit, F.lit(rf"^{PART}(\.{PART}){{3}}$")))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False)).otherwise(n.between(8, 15))
    )


def described(name: str, kind: str) -> Column:
    """The matches of one pattern, each with what stands before it since the last one."""
    pieces = F.col(f"p_{name}")
    zipped = F.arrays_zip(F.col(f"h_{name}").alias("hit"), pieces.alias("piece"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("next"))

    def short(x, i):
        before, after = F.right(x["piece"], F.lit(BEFORE)), F.left(x["next"], F.lit(NEAR))
        gap = F.length(x["piece"]).cast("long")
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), i.cast("long").alias("i"), gap.alias("gap"), x["hit"].alias("hit"), before.alias("before"), after.alias("after"))

    return F.when(F.size(F.col(f"h_{name}")) > 0, F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), short))


def matches(docs: DataFrame) -> DataFrame:
    """``_row, doc_id, name, kind, i, gap, hit, before, after`` of all matches, and a row without ``name`` for each document."""
    named = [(k, k, p) for k, p in BASE.items()] + list(CANDIDATES)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.when(F.rlike(text, F.lit(ANY)), text).alias("text"))
    rows = rows.withColumns({f"has_{k}": F.rlike(F.col("text"), F.lit(p)) for k, p in NEEDS.items()})
    cut = {}
    for name, _, pattern in named:
        holds = F.col(f"has_{NEED[name]}")
        cut[f"h_{name}"] = F.when(holds, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        cut[f"p_{name}"] = F.when(holds, F.split("text", pattern, -1))
    rows = rows.withColumns(cut)
    lists = [described(name, kind) for name, kind, _ in named]
    text = F.lit(None).cast("string")
    none = F.slice(F.array(F.lit(None)), 1, 0)
    marker = F.array(F.struct(text.alias("name"), text.alias("kind"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("gap"), text.alias("hit"), text.alias("before"), text.alias("after")))
    return rows.select("_row", "doc_id", F.explode(F.concat(marker, *[F.coalesce(x, none) for x in lists])).alias("m")).select("_row", "doc_id", "m.*")


def placed(found: DataFrame) -> DataFrame:
    """Matches with ``start, end`` (code points); base matches that fail their check go."""
    long = F.length("hit")
    until = F.sum(F.col("gap") + F.coalesce(long, F.lit(0))).over(Window.partitionBy("_row", "name").orderBy("i"))
    spans = found.withColumn("end", until).withColumn("start", F.col("end") - long).withColumn("base", F.col("name") == F.col("kind"))
    return spans.filter(F.col("name").isNull() | ~F.col("base") | passes(F.col("kind"), F.col("hit"))).drop("i", "gap")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voted(spans: DataFrame) -> DataFrame:
    """Spans with the labelers' votes and what else the classifier sees of a span's form."""
    kind, hit, digits = F.col("kind"), F.col("hit"), digits_of(F.col("hit"))
    n = F.length(digits)
    of = lambda **by: reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(by.items())[1:], F.when(kind == list(by)[0], by[list(by)[0]]))
    glued = F.rlike(F.col("before"), F.lit(r"[0-9A-Za-z_=\"/]$")) | F.rlike(F.col("after"), F.lit(r"^[0-9A-Za-z_=\"]"))
    form = of(
        email=F.rlike(hit, F.lit(r"^[A-Za-z0-9._%+-]{1,64}\W{1,3}(?:at\W{1,2})?[A-Za-z0-9-]+\W")), ip=F.rlike(hit, F.lit(r"^[0-9]{1,3}(\W{1,3}[0-9]{1,3}){3}$|:")),
        card=F.rlike(hit, F.lit(r"^([0-9]{15,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$")), phone=F.rlike(hit, F.lit(r"^\+|^\([0-9]{3}\)|^[0-9]{3}-[0-9]{3}-")),
    )
    check = of(
        email=F.rlike(hit, F.lit(r"[A-Za-z]{2,24}$")), ip=F.contains(hit, F.lit(":")) | passes(F.lit("ip"), F.regexp_replace(hit, r"[\[\]]", "")), card=F.when(n.between(15, 19), luhn(digits)).otherwise(False), phone=n.between(8, 15)
    )
    known = of(email=F.rlike(F.lower(hit), F.lit(TOP_DOMAINS)), ip=~F.rlike(hit, F.lit(SPECIAL_NETWORKS)), card=F.rlike(digits, F.lit(ISSUERS)), phone=F.rlike(hit, F.lit(COUNTRY_CODES)))
    unknown = of(email=F.lit(False), ip=F.rlike(hit, F.lit(SPECIAL_NETWORKS)), card=~F.rlike(digits, F.lit(ISSUERS)), phone=F.rlike(hit, F.lit(r"^\+0")))
    said = of(**{k: F.rlike(F.col("before"), F.lit(p)) for k, p in CONTEXT.items()})
    return spans.withColumns(
        {
            "form": vote(form & ~glued, ~form | glued), "check": vote(check, ~check), "gazetteer": vote(known, unknown), "context": vote(said, F.rlike(F.col("before"), F.lit(NOT_PERSONAL))),
            "neighbour": vote(F.col("beside"), F.lit(False)), "glued": glued.cast("int"), "size": F.when(n < 8, 0).when(n < 13, 1).when(n < 16, 2).otherwise(3),
        }
    )


def weigh(weights: dict[str, float], *keys: Column) -> Column:
    """Sum of the weights under ``keys``; unknown ones weigh nothing."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(table, k), F.lit(0.0)) for k in keys])


def keyed(names: tuple[str, ...]) -> list[Column]:
    return [F.concat_ws("|", "kind", F.lit(c), F.col(c).cast("string")) for c in names]


def reliabilities(patterns: DataFrame, rounds: int = 20) -> tuple[dict[str, float], dict[str, float]]:
    """(log odds of each kind of base spans and of candidates, log odds that each vote of a labeler adds), by expectation-maximisation.

    ``patterns``: kind, base, a column for each labeler, n.  Candidates are
    taken to be as often false as real where there are few.  Each labeler is taken
    to be right rather than wrong by as much as ten spans' votes, which decides
    where the data have none that are false.
    """
    groups = [f"{k}|base|{b}" for k in KINDS for b in (0, 1)]
    prior = dict.fromkeys(groups, 0.0)
    worth = {f"{k}|{c}|{v}": 1.0 * v for k in KINDS for c in LABELERS for v in (-1, 0, 1)}
    # Of ten spans, real and false: votes against, abstentions, votes for.  Hardly a real span fails its check.
    usual = {True: {-1: 1.0, 0: 3.0, 1: 6.0}, False: {-1: 6.0, 0: 3.0, 1: 1.0}}
    taken = {c: usual for c in LABELERS} | {"check": usual | {True: {-1: 0.05, 0: 0.05, 1: 9.9}}}
    for _ in range(rounds):
        chance = 1 / (1 + F.exp(-weigh(prior | worth, *keyed(("base", *LABELERS)))))
        each = patterns.select("kind", "n", chance.alias("p"), F.explode(F.array(*[F.struct(F.lit(c).alias("labeler"), F.col(c).alias("vote")) for c in ("base", *LABELERS)])).alias("x"))
        sums = each.groupBy("kind", "x.labeler", "x.vote").agg(F.sum(F.col("n") * F.col("p")).alias("real"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false")).collect()
        real = {(r["kind"], r["labeler"], r["vote"]): r["real"] for r in sums}
        false = {(r["kind"], r["labeler"], r["vote"]): r["false"] for r in sums}
        new = {}
        for k in KINDS:
            totals = [sum(t.get((k, LABELERS[0], v), 0.0) for v in (-1, 0, 1)) for t in (real, false)]
            for b in (0, 1):
                prior[f"{k}|base|{b}"] = log((real.get((k, "base", b), 0.0) + 5) / (false.get((k, "base", b), 0.0) + 5))
            for c in LABELERS:
                for v in (-1, 0, 1):
                    new[f"{k}|{c}|{v}"] = log((real.get((k, c, v), 0.0) + taken[c][True][v]) / (totals[0] + 10)) - log((false.get((k, c, v), 0.0) + taken[c][False][v]) / (totals[1] + 10))
        moved = max(abs(new[x] - worth[x]) for x in new)
        worth = new
        if moved < 1e-3:
            break
    return prior, worth


#: What the classifier sees, by kind.
FEATURES = (*LABELERS, "base", "glued", "size", "bias")


def classifier(shapes: DataFrame, rounds: int = 25, ridge: float = 0.01) -> dict[str, float]:
    """Weights of a logistic regression on chances: ``shapes`` has kind, FEATURES, n and real (the sum of chances).

    Each round takes a Newton step along every weight, shortened by the number
    of weights that move together.
    """
    weights: dict[str, float] = {"": 0.0}
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-weigh(weights, *keyed(FEATURES))))
        each = shapes.select(F.explode(F.array(*keyed(FEATURES))).alias("key"), (F.col("real") - F.col("n") * p).alias("pull"), (F.col("n") * p * (1 - p)).alias("curve"))
        for r in each.groupBy("key").agg(F.sum("pull").alias("pull"), F.sum("curve").alias("curve")).collect():
            w = weights.get(r["key"], 0.0)
            weights[r["key"]] = w + (r["pull"] - ridge * w) / (len(FEATURES) * r["curve"] + ridge)
    return weights


def find_personal(spark: SparkSession, docs: DataFrame, sure: float = 0.9, ws: Workspace | None = None) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs(doc_id, text)``; spans are structs of kind, start, end, base, chance, sorted by kind and start.

    Base spans have no chance and always stay.  A candidate is added if the
    classifier gives it a chance of at least ``sure``, neither its check nor
    the labelers' weighed votes are against it, and it overlaps no base span; of candidates that overlap each other only the likeliest (then the
    longest, then the first) stays.  Places are code points, ends exclusive.
    Null and empty texts have no spans; repeated rows each get theirs; a null
    doc_id is kept; other columns go; an empty table gives an empty one.
    """
    ws = ws or Workspace(spark, "personal-data")
    found = ws.save(matches(docs), "matches").repartition("_row")
    spans = placed(found)
    # Overlaps and neighbours: base ends before and base starts behind, of all kinds.
    line = Window.partitionBy("_row").orderBy("start", "end")
    upto, behind = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    only = lambda c: F.when(F.col("base"), F.col(c))
    spans = spans.withColumns({"last_end": F.max(only("end")).over(upto), "next_start": F.min(only("start")).over(behind)})
    overlaps = F.coalesce(F.col("last_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_start") < F.col("end"), F.lit(False))
    close = F.coalesce(F.col("start") - F.col("last_end") <= NEAR, F.lit(False)) | F.coalesce(F.col("next_start") - F.col("end") <= NEAR, F.lit(False))
    spans = spans.filter(F.col("name").isNull() | F.col("base") | ~overlaps).withColumn("beside", close & ~overlaps).drop("last_end", "next_start")
    spans = ws.save(voted(spans).drop("before", "after", "hit"), "spans")

    named = spans.filter("name is not null").withColumn("base", F.col("base").cast("int"))
    patterns = ws.save(named.groupBy("kind", "base", *LABELERS).agg(F.count(F.lit(1)).alias("n")), "patterns").coalesce(1)
    prior, worth = reliabilities(patterns)
    odds = weigh(prior | worth, *keyed(("base", *LABELERS)))
    seen = named.withColumn("bias", F.lit(1))
    shapes = seen.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n")).withColumn("real", F.col("n") / (1 + F.exp(-odds)))
    weights = classifier(ws.save(shapes, "shapes").coalesce(1))

    chance = 1 / (1 + F.exp(-weigh(weights, *keyed(FEATURES))))
    judged = spans.withColumns({"bias": F.lit(1), "is_base": F.col("base"), "base": F.col("base").cast("int")})
    judged = judged.withColumn("chance", F.when(~F.col("is_base"), F.when((F.col("check") >= 0) & (odds >= 0), chance).otherwise(0.0))).withColumn("base", F.col("is_base"))
    judged = judged.filter(F.col("name").isNull() | F.col("base") | (F.col("chance") >= sure)).select("_row", "doc_id", "kind", "start", "end", "base", "chance")
    # Candidates that overlap are one heap: it begins where none before reaches.
    added = F.coalesce(~F.col("base"), F.lit(False))
    order = Window.partitionBy("_row").orderBy("start", "end")
    reached = F.max(F.when(added, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heaps = judged.withColumn("begins", F.when(added & (F.col("start") < reached), 0).otherwise(1)).withColumn("heap", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("_row", "heap").orderBy(F.when(added, 0).otherwise(1), F.desc("chance"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    heaps = heaps.withColumn("place", F.row_number().over(best)).filter(~added | (F.col("place") == 1))
    at = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(at.alias("at"), "start", "end", F.col("base").cast("int").alias("base"), "kind", "chance"))
    rows = heaps.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    shown = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (x["base"] == 1).alias("base"), x["chance"].alias("chance"))
    return rows.select("doc_id", F.transform("spans", shown).alias("spans"))
