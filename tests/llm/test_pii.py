"""Personal data: base rules against Python's re, added spans, hard texts."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from fathomline.llm import pii, queries

SF = "/root/testdata/sf0.001"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    "mail a.b@c.d.e_x@f.g and x@y z@w.1. @@a@b.c@d.e",
    "ip 1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5.6.7.8 1.2.3 999.1.1.1.1 0000256.1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111119999999 4111  1111 1111 1111 1 4 55",
    "phones +1 (988) 555-2485, +12 +123456789012345 +1234567890123456 ++4412345678 9 +1 2 3 4 5 6 7 8 9 0 ()",
    "😀 é a@b.co +4912345678901 10.0.0.1\n4111111111111111",
    "a@b-.-c +1.2.3.4.5.6.7.8.9.0 1.2.3.4@x.y",
    None,
    "",
]


def test_base_rules_match(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[1], "x")], "doc_id bigint, text string, spans string")
    rows = pii.find(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[1 if r.doc_id is None else r.doc_id]
        assert sorted((s.start, s.kind, s.end) for s in r.spans if s.base) == base_spans(text), text
    assert pii.find(df.limit(0)).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_boosted_pii(spark, SF).collect():
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


def test_trees_add_spans_that_base_rules_miss(spark):
    texts = [
        "phone: (555) 123-4567 and mail: joe (at) site (dot) org",
        "nothing here 12 34",
        "order 555-123-4567, version 1[.]2[.]3[.]999",
        "call me at 555.123.4567 or +49 30 1234567, card 4111/1111/1111/1111",
        "we stay (at) home. We sleep",
        "card 4111/1111/1111/1112",
        None,
    ]
    rows = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    added = {d: [(pii.KINDS[s.kind], texts[d][s.start : s.end]) for s in own if not s.base] for d, own in rows.items()}
    assert added[0] == [("phone", "(555) 123-4567"), ("email", "joe (at) site (dot) org")]
    assert added[3] == [("phone", "555.123.4567"), ("card", "4111/1111/1111/1111")]
    assert all(added[d] == [] for d in (1, 2, 4, 5, 6))


def test_trees_beat_rules_on_cues_that_they_never_saw(spark):
    """Lines of another seed, with the cues that were learned from, then with others: what the base rules find of the personal spans, what the trees add, how much of that is right, and the same for spans without a cue."""
    assert not set().union(*pii.CUES["learned"].values()) & set().union(*pii.CUES["held out"].values())
    model = pii.fit(spark)
    for cues, precision, recall in (("learned", 0.95, 0.93), ("held out", 0.88, 0.9)):
        lines = pii.examples(spark, 3000, seed=77, cues=cues)
        found = pii.find(lines, "id", model=model).withColumnRenamed("doc_id", "id").join(lines, "id").collect()
        hits = lambda r, base: [s for s in r.spans if s.base == base]
        right = lambda r, s: r.personal and (s.start, s.end, s.kind) == (r.start, r.end, r.kind)
        personal = [r for r in found if r.personal]
        by_rules = sum(any(right(r, s) for s in hits(r, True)) for r in found)
        added = [right(r, s) for r in found for s in hits(r, False)]
        assert by_rules / len(personal) < 0.3 and sum(added) / len(added) >= precision, cues
        assert (by_rules + sum(added)) / len(personal) >= recall, cues
        bare = [r for r in personal if not r.cue]
        assert len(bare) > 200 and sum(any(right(r, s) for s in r.spans) for r in bare) / len(bare) >= 0.9
        for r in found:
            assert not any(a.start < b.end and b.start < a.end for a in hits(r, False) for b in hits(r, True))


def test_context_decides_between_equal_forms(spark):
    """The same digits, behind words that no list of the features holds: learned cues for impostors, held-out ones or none for personal spans."""
    texts = ["You can text 555-123-4567", "Signed, Ana (555) 123-4567", "her cell was 212 555 0199", "order no. 555-123-4567", "the invoice 212 555 0199", "the invoice 4111.1111.1111.1111", "my card: 4111.1111.1111.1112", "my card: 4111.1111.1111.1111."]
    rows = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [rows[i] for i in range(8)] == [["555-123-4567"], ["(555) 123-4567"], ["212 555 0199"], [], [], [], [], ["4111.1111.1111.1111"]]


def test_examples_are_what_they_say(spark):
    rows = pii.examples(spark, 2000, seed=5).collect()
    assert rows == pii.examples(spark, 2000, seed=5).collect() and 0.4 < sum(r.personal for r in rows) / 2000 < 0.6
    for r in rows:
        value = r.text[r.start : r.end]
        digits = re.sub("[^0-9]", "", value)
        if pii.KINDS[r.kind] == "card":
            assert luhn(digits) or not r.personal
        if pii.KINDS[r.kind] == "ip":
            assert all(int(x) <= 255 for x in re.findall("[0-9]+", value)) or not r.personal


def test_boosting_learns_and_calibrates():
    rows = [{**dict.fromkeys(pii.LEVELS, 0), "digits": d, "words": f, "yes": 9 if d == 2 and f else 0, "no": 0 if d == 2 and f else 5} for d in range(4) for f in range(2)]
    trees = pii.boost(rows)
    least = pii.calibrated(trees, rows)
    assert [sum(pii.leaf(t, r) for t in trees) >= least for r in rows] == [r["yes"] > 0 for r in rows]
    assert pii.boost([]) == [] and pii.calibrated([], []) == float("inf")


def test_overlaps_are_resolved_in_linear_time(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        spans = sorted({(a := rng.randint(0, 60), rng.randint(0, 3), a + rng.randint(1, 9), rng.random() < 0.5) for _ in range(rng.randint(0, 25))})
        rows.append((i, spans))
    rows.append((60, [(4 * j, j % 4, 4 * j + 3, j % 3 > 0) for j in range(30_000)]))
    kind = "id int, spans array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"
    began = time.time()
    got = {r.id: [tuple(s) for s in r.spans] for r in spark.createDataFrame(rows, kind).select("id", pii.resolved(F.col("spans")).alias("spans")).collect()}
    assert time.time() - began < 60 and got[60] == rows[60][1]
    for i, spans in rows[:60]:
        meets = lambda x, y: x[0] < y[2] and y[0] < x[2]
        clear = [s for s in spans if not s[3] and not any(b[3] and meets(b, s) for b in spans)]
        want = [s for s in spans if s[3]] + [s for n, s in enumerate(clear) if not any(meets(b, s) for b in clear[:n])]
        assert got[i] == sorted(want), spans


def test_hard_texts_take_linear_time(spark):
    hard = ["a" * 400_000 + "@", "a." * 150_000 + "@" + "b." * 150_000, "1" * 300_000, "1 " * 200_000, "+1" + " (" * 200_000, "1." * 200_000, "x@y.z " * 3_000]
    began = time.time()
    rows = pii.find(spark.createDataFrame(list(enumerate(hard)), "doc_id bigint, text string")).select("doc_id", F.size("spans").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows}[6] == 3_000 and time.time() - began < 60


def test_redaction(spark):
    df = pii.find(spark.createDataFrame([(1, "to é a@b.co now")], "doc_id bigint, text string"))
    assert df.select(pii.redacted(F.lit("to é a@b.co now"), F.col("spans"))).first()[0] == "to é [EMAIL] now"
