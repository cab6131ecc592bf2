import random
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import functions as F

from quaywave.llm.pii import KINDS, find_pii, running, spell, words_of

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def spans(frame):
    return [(r["doc_id"], r["base"], r["added"]) for r in frame.select("doc_id", spell(F.col("base")).alias("base"), spell(F.col("added")).alias("added")).collect()]


def test_base_spans_are_those_of_the_plain_patterns(docs_of, edge):
    rng = random.Random(3)
    alphabet = "0123456789" * 3 + "+++ --..@@ab_%()é😀\n"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))) for i in range(10, 1500)]
    rows += [(2000, "4111 1111 1111 1111 x a@b.c_d@e.f 1.2.3.4.5.6.7.8 +1 (017) 555-7713"), (2001, "1" * 5000 + " 4111111111111111"), (2002, "a" * 20000 + "@b.c"), (2003, "0255.1.1.1 256.1.1.1 1.2.3.256")]
    rows += edge
    out = spans(find_pii(docs_of(rows)))
    assert Counter((i, b) for i, b, _ in out) == Counter((i, brute(t)) for i, t in rows)
    assert find_pii(docs_of(rows).limit(0)).count() == 0


def test_contexts_of_seeds_give_away_unseen_identifiers(docs_of):
    rows = [(i, f"filler word{i} reach me at +1 (201) 555-{i:04} after noon and more") for i in range(1000, 1040)]
    rows += [(5000, "please reach me at 555-0199 after noon"), (5001, "version 555-0199 of the text"), (5002, "no context 123-4567 here")]
    out = {i: added for i, _, added in spans(find_pii(docs_of(rows)))}
    assert out[5000] == "phone:19:27" and not out[5001] and not out[5002]
    assert all(not v for i, v in out.items() if i < 5000) and set(KINDS) >= {"phone"}


def test_identifiers_without_digits_and_by_labels(docs_of):
    rows = [(i, f"note {i} write to user{i}@mail{i}.example.org before lunch, contact:u{i}@x.org (now)") for i in range(1000, 1040)]
    rows += [(5000, "é😀 just write to (anna.smith) before lunch"), (5001, "contact:anna now"), (5002, "write more of them to anna for lunch"), (5003, "")]
    rows += [(5004, "write to a@b.cd before lunch"), (None, "write to bob before lunch"), (None, "write to bob before lunch")]
    out = [(i, added) for i, _, added in spans(find_pii(docs_of(rows)))]
    told = dict(out)
    assert told[5000] == "email:18:28" and rows[40][1][18:28] == "anna.smith" and told[5001] == "email:8:12"
    assert not told[5002] and not told[5003] and not told[5004] and all(not a for i, a in out if i is not None and i < 5000)
    assert Counter(a for i, a in out if i is None) == Counter({"email:9:12": 2})


def test_what_is_taken_supports_patterns_of_later_rounds(docs_of):
    rows = [(i, f"dial now +1 (201) 555-{i:04} please text{i}") for i in range(1000, 1100)]
    rows += [(2000 + i, f"dial now x{i}y bitte sehr") for i in range(12)] + [(3000, "so ruf now z9z bitte sehr")]
    out = {i: added for i, _, added in spans(find_pii(docs_of(rows)))}
    assert all(out[2000 + i] == f"phone:9:{11 + len(str(i))}" for i in range(12)) and out[3000] == "phone:11:14"


def test_positions_over_many_blocks(spark):
    lengths = list(range(40000))
    (row,) = spark.createDataFrame([(lengths,)], "x array<int>").select(running(F.col("x")).alias("y"), running(F.col("x"), 8, 3).alias("z"), running(F.slice("x", 1, 5)).alias("few"), running(F.slice("x", 1, 0)).alias("none")).collect()
    told = [0, *accumulate(lengths)][:-1]
    assert row["y"] == told and row["z"] == told and row["few"] == told[:5] and row["none"] == []


def test_words_tile_a_text(docs_of):
    text = "é😀  mail:me -- (a.b) http://x.y/z :: " * 60 + "x" * 3000 + " end\n"
    rows = words_of(docs_of([(1, text)]), "text").orderBy("start", "i").collect()
    pieces = {}
    for r in rows:
        pieces[r["start"]] = r["pieces"]
    solid = lambda t: "".join(t.split())
    assert solid("".join("".join(p) for _, p in sorted(pieces.items()))) == solid(text) and all(text[a:].startswith("".join(p)) for a, p in pieces.items())
    assert len(rows) == sum(map(len, pieces.values())) > 300


def test_many_matches_in_one_text(docs_of):
    text = " ".join(f"u{i}@h{i}.org" for i in range(60000)) + " call 555 0123"
    ((_, base, _),) = spans(find_pii(docs_of([(1, text)])))
    assert base == brute(text)
    text = " ".join(f"write to a{i}b" for i in range(60000)) + " 1.2.3.4"
    ((_, base, _),) = spans(find_pii(docs_of([(1, text)])))
    assert base == brute(text)


def test_plan_has_no_python(docs_of):
    plan = find_pii(docs_of([(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
