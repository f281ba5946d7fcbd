"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Generators propose spans with high recall: one expression for each kind of the base (e-mail, IP, card, phone) and
   looser ones (spelt-out e-mail addresses, phone numbers without a country code, runs of letters and digits that may be
   a key or token, private key blocks, IBAN, IPv6). Proposals may overlap.
2. Every proposal has features of its format (length, digits, separators, variety of signs) and its context (characters on
   either side, a keyword in the 24 characters before, whether a value is assigned). Features are small integers.
3. Boosted trees of depth two are fitted to weak labels: a proposal with a check of its own (range, Luhn, number of digits,
   IBAN remainder) is positive if it passes; for the others a rule of context or form says yes, no or nothing, and the
   trees carry that over to proposals of like format. Some forty seed examples are added. One aggregate over all documents
   counts the labels of each combination of features, so all documents are counted; the fit itself takes at most
   `max_combinations` combinations, the most frequent ones. The trees become one SQL expression.
4. Calibration: documents of one in four hashes are left out of the fit, and on their labels the threshold of each kind is
   the smallest score from which on `precision` of the proposals are positive. Base spans that pass their check always
   stay and base matches that fail it go; others are added if their score reaches the threshold and they overlap no base span and no better one.

Positions are code points, end exclusive. Base matches are leftmost and do not overlap within a kind; a failing match is
dropped and not tried again from a later start.

Rows: a null text is empty and has no span; repeated rows are searched each by itself; nulls in other columns don't
matter; an empty table fits the seeds alone and gives no rows; columns of clashing names are kept by `redact`, and `pii` of
`find_pii` takes the place of a column of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret", "iban", "ipv6"]
#: Generators: kind, expression, what a text must have for it to be tried, whether it belongs to the base. Possessive
#: repeats and the look-behinds change no match; they keep long runs linear and off the stack.
_LOCAL, _KEY = "A-Za-z0-9._%+-", "A-Za-z0-9+/_-"
GENERATORS = [
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    ("card", r"[0-9](?:[ -]?[0-9]){12,}+", r"[0-9](?:[ -]?[0-9]){12}", True),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}+){1,4}", r"[\[(](?:at|AT)[\])]", False),
    ("phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}", False),
    ("secret", rf"(?<![{_KEY}])(?=[A-Za-z+/_-]{{0,120}}[0-9])(?=[0-9+/_-]{{0,120}}[A-Za-z])[{_KEY}]{{12,}}+={{0,2}}", rf"(?<![{_KEY}])[{_KEY}]{{12,}}+", False),
    ("secret", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,30}PRIVATE KEY-----", "PRIVATE KEY", False),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", False),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "[0-9A-Fa-f:]:[0-9A-Fa-f]", False),
]
#: Keywords before a proposal, by group.
KEYWORDS = [r"\b(?:phone|tel|call|mobile|cell|fax|whatsapp|contact)\b", r"\b(?:e-?mail|mail|write|address)\b", r"\b(?:card|visa|mastercard|amex|credit|debit|pay(?:ment)?)\b", r"\b(?:ip|host|server|client|addr|login)\b", r"(?:token|secret|passw(?:or)?d|passwd|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)", r"\b(?:order|invoice|ref|reference|id|no|number|version|isbn|ticket|case|sku|part|commit|sha1?|sha256|md5|hash|checksum|digest)\b"]
_ASSIGNED = r"(?:=|:|=>)\s*[\"'`]?$"
#: Endings of a spelt-out address that are taken for a domain.
_DOMAIN = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|ch|eu|uk)$"
#: Seed examples: a text with one proposal and whether it is personal data.
SEEDS = [
    ("call me at (212) 555-0187 today", 1), ("phone 415-555-0134", 1), ("tel 646.555.0199", 1), ("mobile (303) 555-0142", 1), ("contact 702 555 0111", 1), ("fax (212) 555-0100", 1),
    ("order 212-555-0187 shipped", 0), ("invoice 415.555.0134", 0), ("part 702 555 0111", 0), ("id 303-555-0142", 0), ("ref 646-555-0199", 0), ("isbn 978-316-1484", 0), ("x 100 200 3000", 0), ("sum 111 111 1111", 0),
    ("write to jane.roe (at) example (dot) org", 1), ("mail jroe[at]example.org", 1), ("e-mail j.roe [at] example [dot] com", 1), ("look (at) home . now", 0), ("meet [at] noon . then", 0), ("arrive (at) gate . 12", 0),
    ("pay to DE89370400440532013000 soon", 1), ("iban GB29 NWBK 6016 1331 9268 19", 1), ("account FR1420041010050500013M02606", 1), ("part DE89370400440532013001", 0), ("ref GB29 NWBK 6016 1331 9268 18", 0), ("AB12 CDEF 3456 GHIJ 7890", 0),
    ("host 2001:db8:0:0:8:800:200c:417a up", 1), ("from fe80::1ff:fe23:4567:890a today", 1), ("at 12:34:56 sharp", 0), ("ratio 1:2:3", 0), ("a 10:20:30:40 b", 0),
    ('api_key: "sk-Ab39dkQ8s7Fj2kLmPq0Zx"', 1), ("password=Tr0ub4dor-and-3-more", 1), ("secret = 'x9Kq2LmN8pR4sT6vW1yZ'", 1), ("sha256 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", 0), ("see chapter-section-12 there", 0), ("path /usr/lib/python3/dist", 0), ("id 550e8400-e29b-41d4-a716-446655440000", 0), ("file image-final-2 of", 0),
]
FEATURES = ["kind", "loose", "digits", "before", "after", "word", "separators", "variety", "sign", "letters", "assigned", "mix"]
PRECISION = 0.95
MAX_COMBINATIONS = 20_000
TREES = 24
_RATE = 0.4
_CHUNK = 256


def _starts(steps: Column) -> Column:
    """Running totals before each element, by chunks of 256, so that the work stays near the number of elements."""

    def with_chunks(chunks: Column) -> Column:
        add = lambda a, x: a + x
        before = F.aggregate(chunks, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum")), lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")), lambda a: a["out"])
        return let(before, lambda p: F.transform(steps, lambda _, i: F.get(p, (i / _CHUNK).cast("int")) + F.aggregate(F.slice(steps, (i / _CHUNK).cast("int") * _CHUNK + 1, F.pmod(i, F.lit(_CHUNK))), F.lit(0), add)))

    chunks = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / _CHUNK).cast("int")), lambda c: F.aggregate(F.slice(steps, c * _CHUNK + 1, _CHUNK), F.lit(0), lambda a, x: a + x))
    return let(chunks, with_chunks)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the sum of all digits is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    total = F.aggregate(F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    count = F.length(_digits(match))
    if kind not in BASE_KINDS:
        return F.lit(False)
    if kind == "card":
        return F.when(count.between(13, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    return count.between(9, 15)


def _remainder(match: Column) -> Column:
    """IBAN: the number with its first four signs at the end, letters as 10 to 35, modulo 97."""
    signs = F.split(F.regexp_replace(match, " ", ""), "")
    turned = F.concat(F.slice(signs, F.lit(5), F.size(signs)), F.slice(signs, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _weak_label(g: int, match: Column, tail: Column) -> Column:
    """1, 0 or null: what the form or the context of a looser proposal says; tail: lower-cased text before it."""
    kind, expression, _, _ = GENERATORS[g]
    says = lambda yes, no: F.when(yes, 1).when(no, 0)
    if kind == "email":
        return F.when(match.rlike(_DOMAIN), 1).otherwise(0)
    if kind == "phone":
        return says(tail.rlike(KEYWORDS[0]), tail.rlike(KEYWORDS[5]))
    if kind == "iban":
        return (_remainder(match) == 1).cast("int")
    if kind == "ipv6":
        groups = F.size(F.split(match, ":"))
        return F.when((groups == 8) & ~match.contains("::") | (groups >= 4) & match.contains("::"), 1).otherwise(0)
    if "BEGIN" in expression:
        return F.lit(1)
    named = tail.rlike(KEYWORDS[4]) & tail.rlike(_ASSIGNED)
    return says(named & (_variety(match) >= 8), tail.rlike(KEYWORDS[5]) | match.rlike("^[A-Za-z]+[0-9]{1,4}$|^[0-9]+[A-Za-z]+$|/.*/"))


def _variety(match: Column) -> Column:
    return F.size(F.array_distinct(F.split(match, "")))


def _side(char: Column) -> Column:
    """0 nothing, 1 white space, 2 a digit, 3 a letter, 4 anything else."""
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike("[0-9]"), 2).when(char.rlike(r"\p{L}"), 3).otherwise(4)


def _features(g: int, match: Column, before: Column, after: Column) -> Column:
    kind, _, _, base = GENERATORS[g]
    digits = _digits(match)
    tail = F.lower(F.substring(before, -24, 24))
    word = F.lit(0)
    for k, expression in reversed(list(enumerate(KEYWORDS, 1))):
        word = F.when(tail.rlike(expression), k).otherwise(word)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(int(not base)).alias("loose"), F.least(F.length(digits), F.lit(20)).alias("digits"), _side(F.substring(before, -1, 1)).alias("before"), _side(F.substring(after, 1, 1)).alias("after"), word.alias("word"),
        F.least(F.length(F.regexp_replace(match, "[^ .()-]", "")), F.lit(5)).alias("separators"), F.least(F.size(F.array_distinct(F.split(digits, ""))), F.lit(6)).alias("variety"), F.when(match.startswith("+"), 1).when(match.contains("("), 2).otherwise(0).alias("sign"), F.least((F.length(F.regexp_replace(match, "[^A-Za-z]", "")) / 8).cast("int"), F.lit(4)).alias("letters"),
        tail.rlike(_ASSIGNED).cast("int").alias("assigned"), F.least((_variety(match) / 4).cast("int"), F.lit(6)).alias("mix"),
    )


_SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,label:int,f:struct<" + ",".join(f"{f}:int" for f in FEATURES) + ">>>"


def _proposals(text: Column, g: int) -> Column:
    kind, expression, needs, base = GENERATORS[g]

    def spans(pieces: Column, matches: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))

        def span(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(F.get(pieces, i))
                passes = _passes(kind, m)
                label = passes.cast("int") if base else _weak_label(g, m, F.lower(F.substring(F.get(pieces, i), -24, 24)))
                return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), (passes if base else F.lit(False)).alias("base"), label.alias("label"), _features(g, m, F.get(pieces, i), F.get(pieces, i + 1)).alias("f"))

            return F.transform(matches, one)

        return let(steps, lambda s: let(_starts(s), span))

    found = let(F.regexp_extract_all(text, F.lit(expression), 0), lambda matches: F.when(F.size(matches) > 0, let(F.split(text, expression, -1), lambda pieces: spans(pieces, matches))).otherwise(F.array().cast(_SPAN)))
    tried = text.contains(needs) if needs == "@" else text.rlike(needs)
    return F.when(tried, found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def proposals(text: Column) -> Column:
    """All proposals of a text; empty for a null text."""
    some = F.concat(*(_proposals(text, g) for g in range(len(GENERATORS))))
    return F.when(text.rlike("[0-9@:]|[(\\[](?:at|AT)[)\\]]"), some).otherwise(F.array().cast(_SPAN))


class Trees:
    """Boosted trees over integer features, as a plain list of (feature, bound, (feature, bound, low, high) twice)."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]], trees: int = TREES) -> None:
        """rows: features, positives, negatives."""
        pos, neg = sum(r[1] for r in rows) + 1, sum(r[2] for r in rows) + 1
        self.start = math.log(pos / neg)
        self.trees: list = []
        scores = [self.start] * len(rows)
        for _ in range(trees if len(rows) > 1 else 0):
            grads = []
            for (_, p, n), s in zip(rows, scores, strict=True):
                q = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
                grads.append((p - (p + n) * q, (p + n) * q * (1 - q)))
            tree = self._grow([r[0] for r in rows], grads, list(range(len(rows))), 2)
            self.trees.append(tree)
            scores = [s + self._value(tree, r[0]) for r, s in zip(rows, scores, strict=True)]

    def _grow(self, x: list, grads: list, at: list[int], depth: int):
        g, h = sum(grads[i][0] for i in at), sum(grads[i][1] for i in at)
        leaf = _RATE * max(-4.0, min(4.0, g / (h + 1)))
        best = (1e-9, None, None)
        for f in range(len(FEATURES)) if depth and len(at) > 1 else ():
            sums: dict[int, list[float]] = {}
            for i in at:
                s = sums.setdefault(x[i][f], [0.0, 0.0])
                s[0] += grads[i][0]
                s[1] += grads[i][1]
            gl = hl = 0.0
            for bound in sorted(sums)[:-1]:
                gl, hl = gl + sums[bound][0], hl + sums[bound][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, f, bound)
        if best[1] is None:
            return leaf
        _, f, bound = best
        low, high = [i for i in at if x[i][f] <= bound], [i for i in at if x[i][f] > bound]
        return (f, bound, self._grow(x, grads, low, depth - 1), self._grow(x, grads, high, depth - 1))

    def _value(self, tree, x: tuple[int, ...]) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.start + sum(self._value(t, x) for t in self.trees)))))

    def column(self, f: Column) -> Column:
        """The score as an expression on a struct of features."""

        def expression(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[FEATURES[tree[0]]] <= tree[1], expression(tree[2])).otherwise(expression(tree[3]))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + expression(tree)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))

    def thresholds(self, rows: list[tuple[tuple[int, ...], float, float]], precision: float) -> list[float]:
        """For each kind a score from which on the precision holds, halfway to the next smaller one; 2 (never) if none does."""
        out = []
        for k in range(len(KINDS)):
            best, p, n = 2.0, 0.0, 0.0
            scored = sorted(((self.score(x), a, b) for x, a, b in rows if x[0] == k), reverse=True)
            for i, (s, a, b) in enumerate(scored):
                p, n = p + a, n + b
                below = scored[i + 1][0] if i + 1 < len(scored) else 0.0
                if below < s and p / (p + n) >= precision:
                    best = (s + below) / 2
            out.append(max(best, 0.5))
        return out


def fit(docs: DataFrame, precision: float = PRECISION, max_combinations: int = MAX_COMBINATIONS) -> tuple[Trees, list[float]]:
    """Trees from the weak labels of three quarters of the documents and the seeds, thresholds from those of the last quarter."""
    spark = docs.sparkSession
    labelled = docs.select((F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held"), F.explode(proposals(F.col("text"))).alias("p")).where("p.label is not null")
    counted = labelled.select("held", "p.f.*", "p.label").groupBy(*FEATURES).agg(*(F.sum(F.when(F.col("held") == held, F.col("label") == label).cast("int")).alias(name) for name, held, label in (("pos", False, 1), ("neg", False, 0), ("pos_held", True, 1), ("neg_held", True, 0))))
    total = sum((F.coalesce(c, F.lit(0)) for c in ("pos", "neg", "pos_held", "neg_held")), F.lit(0))
    weak = counted.orderBy(total.desc(), *FEATURES).limit(max_combinations).collect()
    seeds = spark.createDataFrame(SEEDS, "text string, truth int").select("truth", F.explode(F.filter(proposals(F.col("text")), lambda p: ~p["base"])).alias("p")).select("truth", "p.f.*").collect()
    rows, held = ({tuple(r[f] for f in FEATURES): [float(r[f"pos{part}"] or 0), float(r[f"neg{part}"] or 0)] for r in weak} for part in ("", "_held"))
    for r in seeds:
        for part in (rows, held):
            part.setdefault(tuple(r[f] for f in FEATURES), [0.0, 0.0])[1 - r["truth"]] += 5.0
    trees = Trees([(x, p, n) for x, (p, n) in sorted(rows.items()) if p + n])
    return trees, trees.thresholds([(x, p, n) for x, (p, n) in sorted(held.items()) if p + n], precision)


def spans_of(text: Column, trees: Trees, thresholds: list[float]) -> Column:
    """Accepted spans (kind, start, end, base), by kind and start."""

    def chosen(found: Column) -> Column:
        base = F.filter(found, lambda p: p["base"])
        limit = F.array(*(F.lit(float(t)) for t in thresholds))
        scored = F.transform(F.filter(found, lambda p: p["f"]["loose"] == 1), lambda p: F.struct((-trees.column(p["f"])).alias("s"), p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind")))
        over = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])

        def added(kept: Column) -> Column:
            likely = F.array_sort(F.filter(scored, lambda p: (-p["s"] >= F.get(limit, p["kind"])) & ~F.exists(kept, lambda b: over(p, b))))
            one = "array<struct<s:double,start:int,end:int,kind:int>>"
            return F.aggregate(likely, F.array().cast(one), lambda a, p: F.when(F.exists(a, lambda b: over(p, b)), a).otherwise(F.concat(a, F.array(p)).cast(one)))

        plain = lambda ps, flag: F.transform(ps, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), F.lit(flag).alias("base")))
        return let(base, lambda b: F.array_sort(F.concat(plain(b, True), plain(added(b), False))))

    kind = "array<struct<kind:int,start:int,end:int,base:boolean>>"
    return let(proposals(text), lambda found: F.when(F.size(found) > 0, chosen(found).cast(kind)).otherwise(F.array().cast(kind)))


def find_pii(docs: DataFrame) -> DataFrame:
    """The documents' columns with `pii`, the accepted spans."""
    trees, thresholds = fit(docs.select(F.col("text").cast("string").alias("text")))
    return docs.withColumn("pii", spans_of(F.coalesce(F.col("text").cast("string"), F.lit("")), trees, thresholds))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"].cast("string"), p["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every accepted span replaced by its kind, such as [EMAIL] or [SECRET]; their columns are unchanged.

    Spans of different kinds may overlap: the one that starts first (then the longer one) is replaced and the others'
    remainder is cut.
    """
    trees, thresholds = fit(docs.select(F.col("text").cast("string").alias("text")))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    held = docs.withColumn("_lacuna_pii", spans_of(F.coalesce(F.col("text").cast("string"), F.lit("")), trees, thresholds))
    text = F.col("text")

    def cut(spans: Column) -> Column:
        ranked = F.array_sort(F.transform(spans, lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("end"), p["kind"].alias("kind"))))
        kind = "struct<at:int,out:array<string>>"
        put = lambda a, p: F.struct(F.greatest(a["at"], -p["end"]).alias("at"), F.when(p["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, p["start"] - a["at"]), F.get(names, p["kind"])))).otherwise(a["out"]).alias("out")).cast(kind)
        return F.aggregate(ranked, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind), put, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    return held.withColumn("text", F.when(F.size("_lacuna_pii") > 0, cut(F.col("_lacuna_pii"))).otherwise(text)).select(docs.columns)
