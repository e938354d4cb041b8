"""Personal data: generators propose spans, boosted trees score them by format and context, and a calibrated threshold selects; DataFrame functions only.

Generators are patterns of high recall. Some are base rules, whose valid matches always stay; the others propose spans that base rules miss (phones without a plus,
spelled-out emails, cards with other separators, defanged addresses), and much that only looks like them. Every candidate becomes a short vector of levels.

No table says what is personal, so everything is learned from examples(): lines of which each holds one span of a known kind that is personal or an impostor (an order number in the form of a phone, a build, a card with or without a right check
digit, a sentence around "(at)"), made by a hash of their number and a seed. A candidate counts as personal if it is such a span. Three folds of these lines have one task each: the first gives each bucket of hashed context (words before and after, the
beginnings and ends of the nearest, the sign just before) its smoothed log-odds, on the second trees of three levels are boosted over format and those evidences' levels, and on the third the threshold is the lowest score that keeps PRECISION.
No feature holds a word: which words matter is what the buckets learned. The examples' cue words are in two parts, of which fit() sees one; tests measure on the other. Trees become CASE expressions, buckets one literal array.

Positions: split() gives what lies between a pattern's matches and regexp_extract_all() the matches, so running sums of lengths are code point offsets. Patterns
are possessive and start where a run starts, so a text takes time in proportion to its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.shared import written

#: Kinds in the order in which ties are listed.
KINDS = ["email", "ip", "card", "phone"]
#: The base rules. The same matches as [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on, without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators beyond the base rules.
WIDER = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}"),
    ("card", r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9_/]|\.[0-9])"),
    ("phone", r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z+.-])00[1-9][0-9](?:[ ().-]?[0-9]){7,12}+(?![0-9A-Za-z])"),
]
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
#: Bounds between levels of evidence, in log-odds.
STEPS = (-2.5, -1.2, -0.4, 0.4, 1.2, 2.5)
#: Levels of each feature.
LEVELS = {"kind": 4, "digits": 6, "separators": 4, "plus": 2, "format": 2, "shape": 2, "words": 7, "near": 7, "after": 7, "tight": 2}
#: Buckets of hashed context, characters of context before and after a span, words of it that count.
BUCKETS, BEFORE, AFTER, WORDS = 4096, 40, 16, 3
ROUNDS, DEPTH, RATE, PRECISION = 40, 3, 0.4, 0.97
EXAMPLES = 12000
CHUNK = 128
SPAN = "array<struct<start:bigint,end:bigint,kind:int,base:boolean,hit:string,before:string,after:string>>"


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(1, 19), total % 10 == 0).otherwise(False)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(OCTETS)
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after"))

    def step(a: Column, r: Column) -> Column:
        begin = a["at"] + F.length(r["gap"])
        end = begin + F.length(r["hit"])
        found = F.struct(begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), r["hit"].alias("hit"), F.right(r["gap"], F.lit(BEFORE)).alias("before"), F.left(r["after"], F.lit(AFTER)).alias("after"))
        return F.when(r["hit"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(found)).alias("out")))

    return _chunked(rows, F.lit(0).cast("bigint"), step, SPAN)


def _chunked(items: Column, at: Column, step, kind: str) -> Column:
    """Goes over items with a state struct(at, out) and gives out, an array of type `kind`. Arrays are copied when they grow, so long ones are built chunk by chunk."""
    none = F.array().cast(kind)

    def chunk(a: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(a["out"], F.array(own["out"])).alias("out"))

    cut = lambda whole: F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int")), lambda j: F.slice(whole, j * CHUNK + 1, F.lit(CHUNK)))
    chunks = F.transform(F.array(items), cut)[0]  # as an element, the items are made once and not for each chunk
    start = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(chunks, start, chunk)["out"])


def resolved(spans: Column) -> Column:
    """Of spans (start, kind, end, base) by start, then kind: those of base rules, and of the others each that meets none of these and no other before it. Three runs over the list, so a text with many spans takes time in proportion to them."""
    kind = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,clear:boolean>>"

    def run(items: Column, zero: int, meets, reach) -> Column:
        def step(a: Column, s: Column) -> Column:
            out = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), (s["clear"] & (s["base"] | ~meets(a["at"], s))).alias("clear"))
            return F.struct(reach(a["at"], s).alias("at"), F.concat(a["out"], F.array(out)).alias("out"))

        return _chunked(items, F.lit(zero).cast("bigint"), step, kind)

    after_base = lambda at, s: at > s["start"]
    every = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), F.lit(True).alias("clear")))
    every = run(every, 0, after_base, lambda at, s: F.when(s["base"], F.greatest(at, s["end"])).otherwise(at))
    every = F.reverse(run(F.reverse(every), 2**62, lambda at, s: at < s["end"], lambda at, s: F.when(s["base"], F.least(at, s["start"])).otherwise(at)))
    every = run(every, 0, after_base, lambda at, s: F.when(s["clear"] & ~s["base"], F.greatest(at, s["end"])).otherwise(at))
    return F.transform(F.filter(every, lambda s: s["clear"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))


def candidates(text: Column) -> Column:
    """All generators' spans in one array; a generator runs only over texts that can hold a match."""
    number = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": number, "card": text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(SPAN)
    found = [F.when(may[k], _matches(text, k, p, True)).otherwise(none) for k, p in BASE.items()]
    wide = [F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), F.contains(text, F.lit("[.]")), number, number, F.contains(text, F.lit("00"))]
    found += [F.when(w, _matches(text, k, p, False)).otherwise(none) for w, (k, p) in zip(wide, WIDER, strict=True)]
    return F.concat(*found)


def _context(c: Column) -> Column:
    """Three lists of buckets: the words before and the sign just before, beginnings and ends of the two nearest words, the words after."""
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}]+"), 0)
    key = lambda mark: lambda w: F.pmod(F.xxhash64(F.lit(mark), w), F.lit(BUCKETS)).cast("int")
    before = F.reverse(words(c["before"]))
    sign = F.regexp_extract(c["before"], r"([^\p{L}\s]?)\s*$", 1)
    nearest = F.slice(before, 1, F.lit(2))
    return F.struct(
        F.concat(F.transform(F.slice(before, 1, F.lit(WORDS)), key("word")), F.transform(F.slice(before, 1, F.lit(1)), key("next")), F.array(key("sign")(sign))).alias("words"),
        F.concat(F.transform(nearest, lambda w: key("begin")(F.left(w, F.lit(4)))), F.transform(nearest, lambda w: key("end")(F.right(w, F.lit(4))))).alias("near"),
        F.transform(F.slice(words(c["after"]), 1, F.lit(2)), key("after")).alias("after"),
    )


def _evidence(buckets: Column, table: Column) -> Column:
    """The level of the sum of the buckets' log-odds."""
    total = F.aggregate(buckets, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))
    level = F.lit(len(STEPS))
    for i in reversed(range(len(STEPS))):
        level = F.when(total < STEPS[i], i).otherwise(level)
    return level


def _vector(c: Column, odds: list[float], every: bool = False) -> Column:
    """The levels of a candidate, and whether a base rule finds it valid. Base candidates need no context unless every."""
    n = F.length(_digits(c["hit"]))
    size = F.size(F.array_distinct(F.split(F.regexp_replace(c["hit"], "[0-9A-Za-z]", ""), "")))
    ok = F.lit(False)
    for i, kind in enumerate(KINDS):
        ok = F.when(c["kind"] == i, valid(kind, F.regexp_replace(c["hit"], r"\[\.\]", ".") if kind == "ip" else c["hit"])).otherwise(ok)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in odds)), ",").cast("array<double>")  # folded into one literal
    said = {name: _evidence(_context(c)[name], table) for name in ("words", "near", "after")}
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        c["kind"].alias("kind"),
        c["base"].alias("base"),
        (F.when(n < 8, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 17, 4).otherwise(5)).alias("digits"),
        F.least(size, F.lit(3)).alias("separators"),
        flag(F.startswith(c["hit"], F.lit("+"))).alias("plus"),
        flag(ok).alias("format"),
        flag(c["hit"].rlike(r"dot[)\]]|\.[^ ]|^[(0]")).alias("shape"),
        *((x if every else F.when(c["base"], F.lit(len(STEPS) // 2)).otherwise(x)).alias(name) for name, x in said.items()),
        flag(c["before"].rlike("[0-9A-Za-z_]$") | c["after"].rlike("^[0-9A-Za-z_]")).alias("tight"),
        flag(ok).alias("valid"),
    )


#: Cue words of the generated lines, for each kind and for impostors. The first part is learned from; tests measure on the second.
CUES = {
    "learned": {
        "email": ["mail", "write", "contact", "Kontakt", "inbox", "correo", "courriel", "Postfach"],
        "ip": ["host", "server", "address", "login", "gateway", "Rechner", "serveur", "attacker"],
        "card": ["card", "visa", "Karte", "carte", "tarjeta", "credit", "mastercard", "paid"],
        "phone": ["call", "phone", "telephone", "Tel", "mobile", "fax", "dial", "ring", "Telefon", "Handy", "anrufen", "portable", "appelez", "movil", "llame", "hotline", "voicemail", "number"],
        "other": ["order", "invoice", "ISBN", "version", "ref", "serial", "part", "item", "section", "total", "score", "model", "ticket", "Bestellung", "Rechnung", "Artikel", "commande", "facture", "pedido", "factura", "batch", "lot", "case", "release", "firmware", "parcel", "docket"],
    },
    "held out": {
        "email": ["reach", "Adresse", "newsletter", "buzon"],
        "ip": ["router", "node", "proxy", "Knoten"],
        "card": ["amex", "debit", "Kreditkarte", "bancaire"],
        "phone": ["text", "WhatsApp", "cell", "pager", "Rueckruf", "joindre", "celular", "landline"],
        "other": ["build", "catalogue", "shipment", "SKU", "patch", "consignment", "Lieferung", "Aktenzeichen", "reference", "products"],
    },
}
#: What stands around a cue, alone before a personal span without one, and after a span; by whether the span is personal. Then openings, and names and hosts of emails.
FRAMES = ["{0} ", "{0}: ", "{0} ", "my {0}: ", "you can {0} ", "her {0} was ", "his {0} is ", "please {0} me at ", "{0} us on ", "our {0} is ", "{0} unter ", "{0} au ", "{0} al ", "{0}. ", "bitte {0} ", "{0} me: "]
OTHER_FRAMES = ["{0} ", "{0} ", "the {0} ", "{0} no. ", "{0} #", "{0}: ", "{0} nr. ", "new {0} ", "see {0} ", "per {0} ", "{0} id ", "each {0} "]
BARE = ["", "Ana ", "J. Meier, ", "best wishes\n", "Signed, Tom ", "or ", "- ", "me: "]
CLOSINGS = ["", ".", ", thanks", " any time", "\n", " or later", "; bye", ")", " after six", "."]
OTHER_CLOSINGS = ["", ".", " in stock", " today", "\n", " was sold", "; done", ")", " arrived", "."]
OPENINGS = ["", "Hello there. ", "As agreed, ", "See the note below:\n", "und dann ", "(", "pour info : "]
NAMES, HOSTS, ENDS = ["joe", "ana.diaz", "k_meier", "info", "x9", "mary-ann", "p.dupont"], ["site", "mail-host", "example", "uni7", "firma"], ["org", "com", "de", "co.uk", "net"]
#: Who stays at home; sentences with "(at)" have such words before them more often than a cue.
SUBJECTS = ["we ", "they ", "you ", "people ", "wir ", "all ", "I ", ""]
SAYINGS = ["stay{0}home. We", "meet{0}noon.then", "look{0}page. Next", "arrive{0}gate. Five", "all{0}once. Then"]


def examples(spark: SparkSession, n: int = EXAMPLES, seed: int = 1, cues: str = "learned") -> DataFrame:
    """n generated lines: id, text, kind, start, end (of the one span that a line is about; code points), personal and cue (whether a cue word stands before it). Half are personal, of these three in four have a cue; of the impostors nine in ten, and half have a form that can't be personal
    where there is one (of those, half stand behind a cue of their kind). About one line in four has the form of a base rule. cues: the part of CUES. The same for the same arguments."""
    rows = spark.range(n)
    u = lambda salt, k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(k))
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (u(salt, len(options)) + 1).cast("int"))
    digits = lambda salt, k, first="0": F.concat(F.lit(first) if first != "0" else F.lit(""), F.lpad(u(salt, 10 ** (k - (first != "0"))).cast("string"), k - (first != "0"), "0"))
    personal = u("personal", 2) == 0
    join = lambda sep, *parts: F.concat(*[x for p in parts for x in (sep, p)][1:])
    octets = [u(f"octet{i}", 256).cast("string") for i in range(4)]
    sound = personal | (u("sound", 2) == 0)
    wrong = [(F.when(sound, u("octet0", 256)).otherwise(256 + u("octet0", 744))).cast("string"), *octets[1:]]
    stem = F.concat(F.lit("4"), digits("card", 14))
    check = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(stem, d.cast("string")))
    good = F.element_at(F.filter(check, _luhn), 1)
    card = F.when(sound, good).otherwise(F.concat(stem, ((F.right(good, F.lit(1)).cast("int") + 1 + u("off", 9)) % 10).cast("string")))
    fours = [F.substring(card, 4 * i + 1, 4) for i in range(4)]
    three, third, four = digits("area", 3, "5"), digits("mid", 3), digits("line", 4)
    at, dot = pick("at", [" (at) ", "(at)", " [at] ", "[at]"]), pick("dot", [" (dot) ", "[dot]", ".", "(dot)"])
    spelled = F.when(personal, F.concat(pick("name", NAMES), at, pick("host", HOSTS), dot, pick("end", ["org", "com", "de", "net"]))).otherwise(F.replace(pick("saying", SAYINGS), F.lit("{0}"), at))
    forms = [
        ("phone", F.concat(F.lit("("), three, F.lit(") "), third, F.lit("-"), four)),
        ("phone", join(pick("gap", ["-", ".", " "]), three, third, four)),
        ("phone", F.concat(F.lit("00"), pick("country", ["49", "33", "34", "44"]), pick("gap", ["", " ", "-"]), digits("area", 2, "3"), pick("gap2", [" ", "", "-"]), digits("line", 7))),
        ("email", spelled),
        ("ip", join(F.lit("[.]"), *wrong)),
        ("card", join(pick("gap", [".", "_", "/"]), *fours)),
        ("phone", F.concat(F.lit("+"), pick("country", ["49", "33", "34", "1"]), F.lit(" "), three, pick("gap", [" ", "-"]), F.when(personal, F.concat(third, four)).otherwise(F.lit("1")))),
        ("email", F.concat(pick("name", NAMES), F.lit("@"), pick("host", HOSTS), F.when(personal, F.concat(F.lit("."), pick("end", ENDS))).otherwise(F.lit("")))),
        ("ip", join(F.lit("."), *wrong)),
        ("card", join(pick("gap", [" ", "-"]), *fours)),
    ]
    usual = F.element_at(F.array(*map(F.lit, [1, 1, 1, 1, 2, 3, 3, 4, 4, 5, 5, 5])), (u("form", 12) + 1).cast("int"))  # order numbers seldom have brackets or a country's prefix
    form = F.when(u("base", 4) == 0, 6 + u("form", 4)).when(personal | (u("rare", 40) == 0), u("form", 6)).otherwise(usual)
    value, kind, cue = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, own) in enumerate(forms):
        value, kind, cue = F.when(form == i, own).otherwise(value), F.when(form == i, KINDS.index(name)).otherwise(kind), F.when(form == i, pick("cue", CUES[cues][name])).otherwise(cue)
    said = F.when(personal, u("said", 4) > 0).otherwise(u("said", 10) > 0)
    named = personal | (~sound & kind.isin(KINDS.index("ip"), KINDS.index("card")) & (u("named", 2) == 0))  # half of the spans of a form that can't be personal are called what they seem to be
    lead = F.when(named, F.replace(pick("frame", FRAMES), F.lit("{0}"), cue)).otherwise(F.replace(pick("frame", OTHER_FRAMES), F.lit("{0}"), pick("cue", CUES[cues]["other"])))
    lead = F.when(said, lead).when(personal, pick("bare", BARE)).otherwise(F.lit(""))
    lead = F.when(~personal & (form == 3) & (u("subject", 4) > 0), pick("subject", SUBJECTS)).otherwise(lead)
    after = F.when(personal, pick("close", CLOSINGS)).otherwise(pick("close", OTHER_CLOSINGS))
    lines = rows.select("id", F.concat(pick("open", OPENINGS), lead).alias("before"), value.alias("value"), after.alias("after"), kind.alias("kind"), personal.alias("personal"), said.alias("cue"))
    return lines.select("id", F.concat("before", "value", "after").alias("text"), "kind", F.length("before").cast("bigint").alias("start"), (F.length("before") + F.length("value")).cast("bigint").alias("end"), "personal", "cue")


def boost(rows: list[dict], rounds: int = ROUNDS) -> list[tuple]:
    """Trees of DEPTH levels for the logistic loss over counted vectors (levels, yes, no). A tree: (feature, level, left, right), a leaf a number; left: level or less."""
    score = [0.0] * len(rows)
    trees: list = []

    def split(own: list[int], gradient: list[float], weight: list[float]) -> tuple | None:
        total_g, total_w, best = sum(gradient[i] for i in own), sum(weight[i] for i in own), None
        for f, n in LEVELS.items():
            g, w = [0.0] * n, [0.0] * n
            for i in own:
                g[rows[i][f]] += gradient[i]
                w[rows[i][f]] += weight[i]
            left_g = left_w = 0.0
            for level in range(n - 1):
                left_g += g[level]
                left_w += w[level]
                if left_w > 1e-9 and total_w - left_w > 1e-9:
                    gain = left_g**2 / (left_w + 1) + (total_g - left_g) ** 2 / (total_w - left_w + 1) - total_g**2 / (total_w + 1)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, level)
        return best

    def grow(own: list[int], gradient: list[float], weight: list[float], depth: int):
        best = split(own, gradient, weight) if depth else None
        if best is None:
            return RATE * sum(gradient[i] for i in own) / (sum(weight[i] for i in own) + 1)
        _, f, level = best
        return (f, level, grow([i for i in own if rows[i][f] <= level], gradient, weight, depth - 1), grow([i for i in own if rows[i][f] > level], gradient, weight, depth - 1))

    for _ in range(rounds if rows else 0):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        gradient = [r["yes"] * (1 - q) - r["no"] * q for r, q in zip(rows, p, strict=True)]
        weight = [(r["yes"] + r["no"]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        tree = grow(list(range(len(rows))), gradient, weight, DEPTH)
        trees.append(tree)
        score = [s + leaf(tree, r) for s, r in zip(score, rows, strict=True)]
    return trees


def leaf(tree, row: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def calibrated(trees: list, rows: list[dict], precision: float = PRECISION) -> float:
    """The lowest score from which up the counted rows are valid at this share; infinite if there's none."""
    scored = sorted(((sum(leaf(t, r) for t in trees), r["yes"], r["no"]) for r in rows), reverse=True)
    yes = no = 0
    best = math.inf
    for i, (s, y, n) in enumerate(scored):
        yes, no = yes + y, no + n
        if (i + 1 == len(scored) or scored[i + 1][0] < s) and yes >= precision * (yes + no) and yes:
            best = s
    return best


def _score(trees: list, c: Column) -> Column:
    def case(tree) -> Column:
        return F.when(c[tree[0]] <= tree[1], case(tree[2])).otherwise(case(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    total = F.lit(0.0)
    for t in trees:
        total = total + case(t)
    return total


Model = tuple[list, float, list]


def fit(spark: SparkSession, n: int = EXAMPLES, seed: int = 1) -> Model:
    """(trees, threshold, log-odds of BUCKETS) from n examples; the driver gets a row for each bucket that occurs, then counted vectors of candidates, no more than there are candidates in the examples."""
    lines = examples(spark, n, seed).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3)))
    found = lines.select("fold", F.struct("start", "end", "kind", "personal").alias("own"), F.explode(candidates(F.col("text"))).alias("c"))
    yes = F.col("own.personal") & (F.col("c.start") == F.col("own.start")) & (F.col("c.end") == F.col("own.end")) & (F.col("c.kind") == F.col("own.kind"))
    found = found.withColumn("yes", yes)
    context = _context(F.col("c"))
    keys = found.where("fold = 0").select("yes", F.explode(F.array_distinct(F.concat(*(context[k] for k in ("words", "near", "after"))))).alias("bucket"))
    odds = [0.0] * BUCKETS
    for r in keys.groupBy("bucket").agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no")).collect():
        odds[r.bucket] = math.log((r.yes + 1.5) / (r.no + 1.5))
    vectors = found.where("fold > 0 and not c.base").select("fold", "yes", _vector(F.col("c"), odds, every=True).alias("c"))
    counts = vectors.groupBy("fold", *(F.col(f"c.{f}").alias(f) for f in LEVELS)).agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no"))
    rows = sorted((r.asDict() for r in counts.collect()), key=lambda r: tuple(r[f] for f in LEVELS))
    trees = boost([r for r in rows if r["fold"] == 1])
    return trees, calibrated(trees, [r for r in rows if r["fold"] == 2]), odds


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each row of docs: doc_id and spans, an array of (start, kind, end, base) by start, then kind as in KINDS; code points, end exclusive.

    All valid matches of the base rules are there, and what the trees add (model: a fit(), made here if there's none), which overlaps none of them. Null and empty texts have none; repeated rows give
    repeated rows; an empty table gives an empty one; other columns aren't read.
    """
    trees, least, odds = model or fit(docs.sparkSession)
    text_ = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.transform(candidates(text_), lambda c: _vector(c, odds)).alias("found"))
    found = written(found, "pii")  # else each use below would search the texts again
    brief = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))
    base = F.transform(F.filter("found", lambda c: c["base"] & (c["valid"] == 1)), brief)
    if math.isinf(least) or not trees:
        return found.select("doc_id", F.array_sort(base).alias("spans"))
    chosen = F.transform(F.filter("found", lambda c: ~c["base"] & (_score(trees, c) >= least)), brief)
    found = found.select("doc_id", base.alias("_base"), chosen.alias("_wide")).select("doc_id", F.size("_wide").alias("_n"), F.array_sort(F.concat("_base", "_wide")).alias("spans"))
    return found.select("doc_id", F.when(F.col("_n") == 0, F.col("spans")).otherwise(resolved(F.col("spans"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as [KIND]; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(names, s["kind"] + 1))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), kept.alias("out")))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
