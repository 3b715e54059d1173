import hashlib
import random
import re

from lexiloom.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return kind == "email" or (16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15)


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(r, text or "") if valid(k, m.group())] for k, r in RAW.items()}


def texts():
    rng = random.Random(4)
    card = lambda: (s := "".join(rng.choices("0123456789", k=15))) + next(d for d in "0123456789" if luhn(s + d))
    some = [None, "", "😀 a@b.c_x@d.e x@y@z.com a@b. .@-.-", "1.2.3.4.5 999.1.1.1.1 0001.0255.3.4 1.2.3", "+1 (988) 555-2485 +12 +123456789012345678", card(), card() + "1", "12 " + card(), "4111 1111 1111 1111\n4111-1111-1111-1111", "a." * 20_000 + "@b.c", "x" * 50_000, "1" * 50_000, "a@b" + ".c" * 20_000]
    parts = ["a@b.c", "1.2.3.4", "@", ".", "+", "-", " ", "é", "😀", "_", "300", "(", ")", "7", card(), "+1 988 555 2485", "\n"]
    return some + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)]


def test_base_spans_are_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "q") for i, t in rows] + [(None, "a@b.c", "q")], "doc_id long, text string, email string")
    out = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in rows:
        wanted = brute(t)
        r = out[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(wanted[k]) for k in pii.KINDS), (i, (t or "")[:200])
        said = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in wanted[k])
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said), (i, t[:200])
    assert out[None].n_email == 1 and pii.report(df.limit(0)).isEmpty()


def corpus(spark):
    fill = ["plain words about nothing much here today", "other lines that say even less again today"]
    rows = [(i, f"start{i} the zorbafon project of bob@corp.com meets today\n{fill[i % 2]}") for i in range(4)]
    rows[1] = (1, "again Zorbafon bob@corp.com went home today")
    rows[2] = (2, "so bob@corp.com wrote zorbafon down today, and bob@corp.com again")
    rows += [(97, "rare1 words1 here: 9.9.9.9 then 9.9.9.9 and 9.9.9.9, unheard of")]
    rows += [(10 + i, f"{fill[i % 2]} number{i}") for i in range(60)] + [(99, "A Zorbafon alone."), (98, "zorbafons aren't")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity(spark):
    df = corpus(spark)
    found = pii.detect(df)
    said = {r.term: (round(r.share, 6), r.removed) for r in pii.disclosing(found).collect()}
    lines = sum(len(r.text.split("\n")) for r in df.collect())
    holds = lambda w: sum(w in re.findall(r"[^\W\d_]+", line.lower()) for r in df.collect() for line in r.text.split("\n"))
    from math import log

    share = log(4 * lines / (holds("zorbafon") * 4)) / log(lines / 4)
    assert said == {"zorbafon": (round(share, 6), share >= 0.95)} and 0.8 <= share < 0.95
    out = {r.doc.doc_id: r for r in pii.sanitise(df).collect()}
    assert out[99].sanitised == "A <TERM> alone." and pii_spans(out[99]) == [("term", 2, 10)]
    assert out[98].sanitised == "zorbafons aren't" and out[1].sanitised == "again <TERM> <EMAIL> went home today"
    gone = {r.doc.doc_id: r.sanitised for r in pii.sanitise(df, removal=0.8).collect()}
    assert gone[99] == "A  alone."
    assert {r.term for r in pii.disclosing(found, support=5).collect()} == set()
    copies = df.unionByName(spark.createDataFrame([(200 + i, "again Zorbafon bob@corp.com went home today") for i in range(9)], df.schema))
    assert pii.disclosing(pii.detect(copies)).isEmpty()


def pii_spans(r):
    return [(s.kind, s.start, s.stop) for s in r["all"]]


def test_cleaned_keeps_columns_and_clean_texts(spark):
    df = spark.createDataFrame([(1, "x a@b.c y", 9, "k"), (2, None, None, None), (3, "clean é", 7, "k"), (3, "clean é", 7, "k")], "doc_id long, text string, n_chars long, row string")
    out = pii.cleaned(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x <EMAIL> y", 11, "k"), (2, None, None, None), (3, "clean é", 7, "k"), (3, "clean é", 7, "k")], key=str)


def test_overlaps_go_with_the_first(spark):
    df = spark.createDataFrame([(1, "call +1.2.3.4.5678 now")], "doc_id long, text string")
    r = pii.sanitise(df).first()
    assert pii_spans(r) == [("ip", 6, 13), ("phone", 5, 18)] and r.sanitised == "call <PHONE> now"


def test_short_names_and_numbers_are_terms_too(spark):
    said = ["then Li 4471 wrote to bob@corp.com again", "call li at bob@corp.com or 4471 now", "is LI (bob@corp.com) 4471?"]
    rows = [*enumerate(said), (90, "Li came home."), (91, "room 4471 is free"), (92, "like 44710 others, Lia")] + [(10 + i, f"plain words w{i} or then again now at home is free") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term for r in pii.disclosing(pii.detect(df)).collect()} == {"li", "4471"}
    out = {r.doc.doc_id: r.sanitised for r in pii.sanitise(df).collect()}
    assert (out[90], out[91], out[92]) == ("<TERM> came home.", "room <TERM> is free", "like 44710 others, Lia")


def test_very_many_matches_keep_their_places(spark):
    text = "".join(f"é {i % 200}.1.2.3 x" for i in range(1500))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.report(df).first()
    assert r.n_ip == 1500 and r.base_sha256 == hashlib.sha256(",".join(f"ip:{a}:{b}" for a, b in brute(text)["ip"]).encode()).hexdigest()
