"""Personal data by candidate gradient boosting, in DataFrame functions only.

Four strict rules find base spans. High-recall generators propose further spans, which may overlap. Boosted trees over
format and context features score each; those above their kind's calibrated threshold are added. Trees are grown in
numpy on the driver from a seeded synthetic set and become column expressions. Thresholds are set on a second set made
of other names, hosts, words and hints.

Work is linear in a text and its spans: patterns have possessive runs and never start in a run's middle, and whatever
goes over spans in order does so in blocks (see swept).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
#: kind: (pattern, cheap test a text must pass, test of a match)
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"\.[0-9]++\."), lambda m: _octets(m)),
    # only whole runs of 16 digits or more, with single blanks or hyphens between digits
    "card": (r"(?=(?:[0-9][\x20-]?){16})[0-9]++(?:[\x20-][0-9]++)*+", lambda t: t.rlike(r"[0-9][0-9\x20-]{15}"), lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(8, 15)),
}
#: Generators of further candidates, of high recall and low precision.
PROPOSE = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[a-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}+){1,8}+", lambda t: t.rlike(r"(?i)[\[({\x20]at[\])}\x20]")),
    "ip": (r"(?i)(?<![0-9a-z:])(?=:{0,2}[0-9a-f])(?:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?+|[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){3,7}+)(?![0-9a-z:])", lambda t: t.rlike(r"(?i)[0-9a-f]:[0-9a-f]{1,4}+:|::")),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])", lambda t: t.rlike(r"[0-9][0-9\x20-]{12}")),
    "phone": (r"(?<![0-9+])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}[\x20.-][0-9]{2,5}(?:[\x20.-][0-9]{1,4})?(?![0-9])", lambda t: t.rlike(r"[0-9]{2}[)\x20./-]")),
}
FEATURES = ("kind", "digits", "length", "marks", "distinct", "luhn", "parens", "before", "after", "context", "colons", "brackets", "joints")
_CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|cell|card|visa|master|amex|credit|mail|contact|write|reach|ip|host|addr|server)[a-z]*[\x20:.#-]{0,3}(?:is|at|on|no|nr|number)?[\x20:.#]*$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, r"\."), small)


def found(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """Leftmost non-overlapping matches, and the texts between them; both empty unless `when`."""
    none = F.array().cast("array<string>")
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(when, F.split(text, pattern, -1)).otherwise(none)


#: Items that one step of a fold copies at most.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def swept(items: Column, state: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A fold over an array in order that gathers output: array<struct<s, out>>, one for each block of items.

    step(state, item) gives the next state and an array of what the item adds. A fold that appends to one array copies
    it for every item; here an item copies its own block's output at most, and the last state stands in the last block.
    """
    def one(acc: Column, item: Column) -> Column:
        after, added = step(acc["s"], item)
        return F.struct(after.alias("s"), F.concat(acc["out"], added).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        return F.array_append(acc, F.aggregate(part, F.struct(F.element_at(acc, -1)["s"].alias("s"), none.alias("out")), one))

    def whole(got: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(got) - 1) / BLOCK).cast("int")), lambda b: F.slice(got, b * BLOCK + 1, BLOCK))
        return F.when(F.size(got) > 0, F.aggregate(blocks, first, block)).otherwise(first)

    first = F.array(F.struct(state.alias("s"), none.alias("out")))
    return bound(items, whole)


def _gathered(folded: Column) -> Column:
    return F.flatten(F.transform(folded, lambda b: b["out"]))


def placed(matches: Column, gaps: Column) -> Column:
    """array<struct<start, end, m, ahead, behind>> in code points, from matches and the gaps between them; ahead and behind are what stands next to a match, up to the match beside it."""
    sizes = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
    ends = _gathered(swept(sizes, F.lit(0), F.array().cast("array<int>"), lambda at, n: (at + n, F.array(at + n))))

    def one(m: Column, i: Column) -> Column:
        ahead = F.right(F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), F.get(gaps, i)), F.lit(24))
        behind = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(matches, i + 1), F.lit(""))), F.lit(1))
        return F.struct(m.alias("m"), ahead.alias("ahead"), behind.alias("behind"))

    return F.zip_with(F.transform(matches, one), ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("m"), x["ahead"].alias("ahead"), x["behind"].alias("behind")))


def features(kind: int, span: Column) -> Column:
    """The struct of FEATURES, all double, of a proposed span."""
    m, digits, ahead = span["m"], _digits(span["m"]), span["ahead"]
    value = {
        "kind": F.lit(kind),
        "digits": F.length(digits),
        "length": F.length(m),
        "marks": F.length(F.regexp_replace(m, r"[^\x20./-]", "")),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "luhn": F.call_function("luhn_check", digits).cast("int"),
        "parens": F.contains(m, F.lit("(")).cast("int"),
        "before": F.right(ahead, F.lit(1)).rlike(r"[A-Za-z0-9.,/#$€£-]").cast("int"),
        "after": span["behind"].rlike(r"[A-Za-z0-9%/-]").cast("int"),
        "context": ahead.rlike(_CONTEXT).cast("int"),
        "colons": F.length(F.regexp_replace(m, "[^:]", "")),
        "brackets": F.length(F.regexp_replace(m, r"[^\[\](){}]", "")),
        "joints": F.contains(m, F.lit("::")).cast("int"),
    }
    return F.struct(*[F.coalesce(value[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


# --- boosting ---------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float = 5.0) -> tuple:
    """A regression tree by second-order gain: (feature, threshold, left, right) or a leaf's value."""
    def gain(g: float, h: float) -> float:
        return g * g / (h + 1.0)

    best = (1e-6, None, None)
    if depth:
        g, h = gradient.sum(), hessian.sum()
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(gradient[order]), np.cumsum(hessian[order])
            for i in np.flatnonzero(np.diff(v)):
                if least <= i + 1 <= len(v) - least:
                    now = gain(gs[i], hs[i]) + gain(g - gs[i], h - hs[i]) - gain(g, h)
                    if now > best[0]:
                        best = (now, f, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return (float(-gradient.sum() / (hessian.sum() + 1.0)),)
    left = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x[left], gradient[left], hessian[left], depth - 1, least), grow(x[~left], gradient[~left], hessian[~left], depth - 1, least))


def predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = predict(tree[2], x[left]), predict(tree[3], x[~left])
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4) -> list[tuple]:
    """Gradient boosting on the logistic loss."""
    z, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(x, p - y, p * (1 - p), depth))
        z += rate * predict(trees[-1], x)
    return trees


def expression(trees: list[tuple], value: Column, rate: float = 0.4) -> Column:
    """The boosted score of a struct of FEATURES as one column expression."""
    def tree(t: tuple) -> Column:
        return F.lit(t[0]) if len(t) == 1 else F.when(value[FEATURES[t[0]]] <= t[1], tree(t[2])).otherwise(tree(t[3]))

    return reduce(lambda a, b: a + b, [tree(t) * F.lit(rate) for t in trees])


def _luhn_fixed(rng: np.random.Generator, n: int) -> str:
    body = [int(d) for d in rng.integers(0, 10, n - 1)]
    body[0] = max(body[0], 1)
    total = sum(d if (n - 1 - i) % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(body))
    return "".join(map(str, body)) + str(-total % 10)


#: What the synthetic sets are made of, for growing trees and for thresholds: words, users, hosts, top domains, and words ahead of e-mails, addresses, cards, phones, and of numbers that are none.
WORLDS = (
    ("the of and report until total about order note page room since value list table under with from", "anna.k b_lee maria42 j.doe", "mail example post9", "com org net", ("mail ", "contact: ", "write to ", ""), ("host ", "ip ", "", "server "), ("card ", "visa: ", "credit card ", "amex "), ("call ", "tel. ", "phone: ", "mobile "), ("on ", "isbn ", "of ", "version ", "$", "")),
    ("a to it was not our new river stone after before house every long summer chapter figure between price", "tom.weber r.s kim_77 lucia o.brien", "inbox acme uni-x web24", "de io edu co", ("e-mail ", "reach ", "contact ", ""), ("address ", "server: ", "", "host: "), ("card no ", "mastercard ", "credit: ", "visa "), ("phone ", "fax ", "cell: ", "call "), ("since ", "no. ", "art. ", "release ", "#", "")),
)


def synthetic(n: int = 2000, seed: int = 17, world: int = 0) -> list[tuple[str, int, int]]:
    """(text, kind, label): each text has one proposed span; label 1 where it is personal data."""
    rng = np.random.default_rng(seed + world)
    said, users, hosts, tops, at_mail, at_host, at_card, at_phone, at_other = WORLDS[world]
    words, users, hosts, tops = said.split(), users.split(), hosts.split(), tops.split()

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def num(k: int) -> str:
        return str(int(rng.integers(10 ** (k - 1), 10**k)))

    rows = []
    for i in range(n):
        kind, good = i % 4, bool(rng.integers(2))
        lead, tail = " ".join(pick(words) for _ in range(4)), " ".join(pick(words) for _ in range(3))
        if kind == 0:
            user, host = pick(users), pick(hosts)
            at, dot = pick([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", ".")])
            if good:
                span, ahead = f"{user}{at}{host}{dot}{pick(tops)}", pick(at_mail)
            else:
                span, ahead = f"{pick(words)} at {pick(words)} dot {pick(words)}", pick(["look ", "stop ", ""])
        elif kind == 1:
            if good:
                parts = [f"{int(rng.integers(0, 65536)):x}" for _ in range(8)]
                short = f"{pick(['2001:db8', 'fe80', '2a02:' + parts[0]])}::{':'.join(parts[: int(rng.integers(0, 5))]) or parts[1]}"
                span, ahead = pick([":".join(parts), short]), pick(at_host)
            else:
                span = pick([":".join(f"{int(rng.integers(0, 60)):02d}" for _ in range(4)), ":".join(f"{int(rng.integers(0, 256)):02x}" for _ in range(6)), f"{pick(['a', 'bad', 'face', 'dead', 'add'])}::{pick(['b', 'cafe', 'feed', 'c'])}", f"{num(1)}::{num(1)}"])
                ahead = pick(["time ", "mac ", ""])
        elif kind == 2:
            size = int(rng.integers(13, 16))
            digits = _luhn_fixed(rng, size if not good else pick([13, 15]))
            if not good and rng.random() < 0.9:
                digits = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
            ahead = pick(at_card) if good else pick(["order ", "isbn ", "id ", "no. ", ""])
            span = digits if rng.random() < 0.6 else " ".join([digits[:4], digits[4:10], digits[10:]])
        else:
            a, b, c = num(3), num(3), num(4)
            if good:
                span = pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{num(3)} {num(3)} {num(4)}"])
                ahead = pick([*at_phone, ""]) if span[0] == "(" else pick(at_phone)
            else:
                span = pick([f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"978-{num(2)}-{num(4)}-{num(3)}", f"{a}-{b}-{c}", f"{num(2)}/{num(2)}-{num(3)}"])
                ahead = pick(at_other)
        rows.append((f"{lead} {ahead}{span} {tail}", kind, int(good)))
    return rows


def calibrated(score: np.ndarray, y: np.ndarray, least: float) -> float:
    """The score from which on the chance of y is at least `least`, by isotonic regression with half a miss added to every step; infinite if there is none.

    Between two steps nothing was seen: the threshold is midway, but never where the trees hold a miss more likely.
    """
    steps: list[list[float]] = []  # lowest score, hits, rows, highest score
    for z, hit, n in zip(*(lambda u, i, c: (u, np.bincount(i, weights=y), c))(*np.unique(score, return_inverse=True, return_counts=True)), strict=True):
        steps.append([float(z), float(hit), float(n), float(z)])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, hits, rows, high = steps.pop()
            steps[-1][1:] = [steps[-1][1] + hits, steps[-1][2] + rows, high]
    good = [i for i, (_, hits, rows, _) in enumerate(steps) if hits / (rows + 0.5) >= least]
    if not good:
        return float("inf")
    low = steps[good[0]][0]
    return max(0.0, (steps[good[0] - 1][3] + low) / 2 if good[0] else low)


_models: dict[int, tuple[list[tuple], list[float]]] = {}


def model(spark: SparkSession, n: int = 2000, least: float = 0.9) -> tuple[list[tuple], list[float]]:
    """Trees grown on one synthetic set, and for every kind the score from which on a span of the other is personal data with a chance of at least `least`. Features come from the same expressions as at scoring."""
    if n not in _models:
        sets = []
        for world in (0, 1):
            rows = spark.createDataFrame(synthetic(n, world=world), "t string, kind int, y int").coalesce(1)
            parts = []
            for k, kind in enumerate(KINDS):
                m, gaps = found(F.col("t"), PROPOSE[kind][0], F.lit(True))
                mine = rows.filter(F.col("kind") == k).withColumn("m", m).withColumn("g", gaps).withColumn("s", F.explode(placed(F.col("m"), F.col("g"))))
                parts.append(mine.select(features(k, F.col("s")).alias("f"), "y"))
            got = reduce(DataFrame.union, parts).select("f.*", "y").collect()
            sets.append(np.array([tuple(r) for r in got], float))
        trees = boost(sets[0][:, :-1], sets[0][:, -1])
        x, y = sets[1][:, :-1], sets[1][:, -1]
        z = 0.4 * sum(predict(t, x) for t in trees)
        thresholds = [calibrated(z[x[:, 0] == k], y[x[:, 0] == k], least) for k in range(len(KINDS))]
        _models[n] = trees, thresholds
    return _models[n]


# --- the operator -----------------------------------------------------------------------------------------------


def _bare(s: Column, kind: Column) -> Column:
    return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _valid(k: int, matches: Column, gaps: Column) -> Column:
    """Base spans of kind k."""
    test = BASE[KINDS[k]][2]
    return F.transform(F.filter(placed(matches, gaps), lambda s: F.coalesce(test(s["m"]), F.lit(False))), lambda s: _bare(s, F.lit(k)))


def _with_features(k: int, matches: Column, gaps: Column) -> Column:
    """Proposed spans of kind k with their features."""
    return F.transform(placed(matches, gaps), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(k, s).alias("f")))


_SPAN = "struct<start:int,end:int,kind:int,z:double>"


def _apart(base: Column, scored: Column) -> Column:
    """Scored spans that overlap no base span and no better scored one, in order.

    One pass from left to right: of two that overlap the better stays (of equals the first), and one that a base span
    overlaps goes; what had lost to it before does not come back.
    """
    def item(s: Column, is_base: int, z: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(1 - is_base).alias("late"), s["end"].alias("end"), s["kind"].alias("kind"), z.alias("z"))

    items = F.array_sort(F.concat(F.transform(base, lambda s: item(s, 1, F.lit(0.0))), F.transform(scored, lambda s: item(s, 0, s["z"]))))
    none, nothing = F.array().cast(f"array<{_SPAN}>"), F.lit(None).cast(_SPAN)

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        top, base_end = s["top"], s["base_end"]
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["z"].alias("z"))
        is_base, beyond = x["late"] == 0, F.coalesce(top["end"] <= x["start"], F.lit(False))
        after = (
            F.when(is_base, F.when(beyond, top))
            .when(x["start"] < base_end, top)
            .when(top.isNull() | beyond | (x["z"] > top["z"]), own)
            .otherwise(top)
        )
        left = ~is_base & (x["start"] >= base_end) & beyond
        return F.struct(F.when(is_base, F.greatest(base_end, x["end"])).otherwise(base_end).alias("base_end"), after.alias("top")), F.when(left, F.array(top)).otherwise(none)

    def ended(folded: Column) -> Column:
        rest = F.element_at(folded, -1)["s"]["top"]
        return F.concat(_gathered(folded), F.when(rest.isNotNull(), F.array(rest)).otherwise(none))

    return bound(swept(items, F.struct(F.lit(0).alias("base_end"), nothing.alias("top")), none, step), ended)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and spans: array<struct<kind, start, end>> by kind, then start, in code points, end exclusive.

    Whole texts are read, of any length, in time linear in the text and its spans; a null text counts as empty. spans
    holds all of base and the added ones; added spans overlap no base span and no better added one. Rows are
    independent: repeated rows get equal results, and an empty table gives an empty one. Columns named base or spans
    are replaced.
    """
    trees, thresholds = model(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    df = docs.select(*kept).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for name, rules in (("b", BASE), ("p", PROPOSE)):
        for kind in KINDS:
            m, g = found(F.col("_t"), rules[kind][0], rules[kind][1](F.col("_t")))
            df = df.withColumn(f"_{name}m_{kind}", m).withColumn(f"_{name}g_{kind}", g)
    spans, wide = [], []
    for k, kind in enumerate(KINDS):
        spans.append(_valid(k, F.col(f"_bm_{kind}"), F.col(f"_bg_{kind}")))
        wide.append(_with_features(k, F.col(f"_pm_{kind}"), F.col(f"_pg_{kind}")))
    df = df.withColumn("base", F.concat(*spans)).withColumn("_wide", F.concat(*wide))
    scored = F.transform("_wide", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), expression(trees, c["f"]).alias("z")))
    df = df.withColumn("_scored", F.filter(scored, lambda c: c["z"] >= F.element_at(F.array(*[F.lit(t) for t in thresholds]), c["kind"] + 1)))
    added = F.transform(_apart(F.col("base"), F.col("_scored")), lambda c: _bare(c, c["kind"]))
    df = df.withColumn("spans", F.when(F.size("_scored") > 0, F.array_sort(F.concat("base", added))).otherwise(F.array_sort("base")))
    return df.select(*kept, "base", "spans")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a text that one access to a place in it passes at most.
CHUNK = 4096


def _between(chunks: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text in chunks."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    one = F.substring(F.get(chunks, i), a % CHUNK + 1, b - a)
    many = F.concat(F.substring(F.get(chunks, i), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(chunks, j), F.lit("")), F.lit(1), b % CHUNK))
    return F.when(b <= a, F.lit("")).when(i == j, one).otherwise(many)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one mark. Null stays null."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(chunks: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            kept = F.array(F.concat(_between(chunks, at, s["start"]), F.element_at(name, s["kind"] + 1)))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, kept).otherwise(F.array().cast("array<string>"))

        def ended(folded: Column) -> Column:
            return F.concat(F.array_join(_gathered(folded), ""), _between(chunks, F.element_at(folded, -1)["s"], F.length(text)))

        return bound(swept(in_order, F.lit(0), F.array().cast("array<string>"), step), ended)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bound(chunks, cut)).otherwise(text)
