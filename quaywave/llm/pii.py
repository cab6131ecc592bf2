"""Personal data: base patterns, and identifiers found from the contexts that the base spans stand in.

DataFrame functions only. Seeds are the base spans; the words next to an instance are its patterns. Patterns
that hold enough different seeds are counted over every word of the corpus; those that hold little else are
worth their share of known instances, and every word that stands in one is a new instance, worth the noisy-or of
its patterns. What is taken adds to its other patterns in the next round: scores pass to and fro over the graph.

All steps are linear in the length of a text: positions are sums over blocks, words are read in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import let
from .common import materialize, member_test, spread_join, text_of

#: Base kinds in their order. The patterns match what the plain ones match from left to right
#: ([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on): possessive, and begun only where a run or the
#: rest of one begins, so that time stays linear. The card pattern holds the 13 to 19 digits of a whole run.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+(?<=[0-9])(?<!\+[0-9])"
#: A word runs to white space, or to the colon or equals sign of a label ("mail:x"). Group 1 is its core, without
#: what is neither letter nor digit at its ends; words without either have an empty core.
_P, _A = r"[^\s\p{L}\p{N}]", r"[\p{L}\p{N}]"
WORD = rf"\s*+(?=\S){_P}*+([A-Za-z]{{2,}}+(?=[:=]++[^\s/])|{_A}++(?:{_P}++{_A}++)*+)?{_P}*+"
CHUNK = r"(?s).{1,4000}+\S*+\s*+"  # some 4000 characters and on to the end of the word
_SPANS = "array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _sums(lengths: Column, start: Column) -> Column:
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(lengths, zero, step, lambda acc: acc["out"])


def running(lengths: Column, block: int = 128, levels: int = 2) -> Column:
    """What adds up before each element. An array longer than a block is summed by blocks, and so are those
    sums, `levels` deep: a plain running sum copies its array at every step."""

    def blocked(x: Column) -> Column:
        index = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / F.lit(block)).cast("int"))
        part = lambda j: F.slice(x, j * F.lit(block) + 1, F.lit(block))
        sums = F.transform(index, lambda j: F.aggregate(part(j), F.lit(0), lambda a, n: a + n))
        starts = running(sums, block, levels - 1) if levels > 1 else _sums(sums, F.lit(0))
        return F.flatten(F.transform(F.arrays_zip(starts.alias("at"), index.alias("j")), lambda y: _sums(part(y["j"]), y["at"])))

    return let(lengths, lambda x: F.when(F.size(x) <= block, _sums(x, F.lit(0))).otherwise(blocked(x)))


def _plain(x: Column) -> Column:
    """Digits made alike, letters small. The two whose small form would move the ends of words become others first."""
    return F.lower(F.replace(F.replace(F.regexp_replace(x, "[0-9]++", "0"), F.lit("\u212a"), F.lit("\u03ba")), F.lit("\u0130"), F.lit("\u0131")))


def _cores(x: Column) -> Column:
    return F.regexp_extract_all(_plain(x), F.lit(WORD), F.lit(1))


def _at(words: Column, i: Column) -> Column:
    return F.coalesce(F.get(words, i), F.lit(""))


def _patterns(left2: Column, left1: Column, right1: Column) -> tuple[Column, Column]:
    """The two words to the left of an instance, and the one on either side; null where those are no words."""
    one = F.when(left1 != "", F.concat(F.lit("L:"), left2, F.lit(" "), left1))
    return one, F.when((left1 != "") & (right1 != ""), F.concat(F.lit("B:"), left1, F.lit(" _ "), right1))


def spans_of(text: Column, pattern: str, kind: int, good=None, context: int = 200) -> Column:
    """All matches, with code-point positions: the lengths of what lies between and of the matches add up.

    A match's patterns come from what lies around it, which the split has already cut out."""
    none, empty = F.array().cast(_SPANS), F.array(F.lit(""))
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def build(x: Column) -> Column:
        hit, gap, n = x["hit"], x["gap"], F.size(x["hit"])
        starts = running(F.transform(F.arrays_zip(gap.alias("g"), hit.alias("h")), lambda y: F.length(y["g"]) + F.coalesce(F.length(y["h"]), F.lit(0))))
        near = F.arrays_zip(
            hit.alias("hit"), F.slice(gap, F.lit(1), n).alias("gap"), F.slice(gap, F.lit(2), n).alias("next"), F.slice(starts, F.lit(1), n).alias("at"),
            F.slice(F.concat(empty, hit), F.lit(1), n).alias("hit0"), F.slice(F.concat(empty, gap), F.lit(1), n).alias("gap0"), F.slice(F.concat(hit, empty), F.lit(2), n).alias("hit1"),
        )
        return F.transform(near if good is None else F.filter(near, lambda y: good(y["hit"])), full)

    def full(y: Column) -> Column:
        start, few = y["at"] + F.length(y["gap"]), F.lit(context)
        left = F.concat(F.right(y["gap0"], few), F.right(y["hit0"], few), F.right(y["gap"], few))
        right = F.concat(F.left(y["next"], few), F.left(y["hit1"], few))
        left, right = F.regexp_replace(left, rf"(?<!{_P}){_P}++$", ""), F.regexp_replace(right, rf"^{_P}++", "")
        both = let(_cores(left), lambda c: F.array(*_patterns(_at(c, F.size(c) - 2), _at(c, F.size(c) - 1), _at(_cores(right), F.lit(0)))))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(y["hit"])).alias("end"), y["hit"].alias("value"), both.alias("patterns"))

    return F.when(text.rlike(pattern), let(F.struct(hits.alias("hit"), gaps.alias("gap")), build)).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def is_ip(x: Column) -> Column:
    part = "0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(9, 15)


def is_card(x: Column) -> Column:
    """Luhn: from the right, every second digit doubled, its digits added; the sum ends in 0."""
    return F.call_function("luhn_check", _digits(x))


def _fingerprint(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def find_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (its fingerprint), base (array of spans with their patterns): slim, written once."""
    text = F.col("text")
    none = F.array().cast(_SPANS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).select(
        "id",
        _fingerprint(text).alias("text"),
        F.concat(
            F.when(F.contains(text, F.lit("@")), spans_of(text, EMAIL, 0)).otherwise(none),
            spans_of(text, IP, 1, is_ip),
            spans_of(text, CARD, 2, is_card),
            F.when(F.contains(text, F.lit("+")), spans_of(text, PHONE, 3, is_phone)).otherwise(none),
        ).alias("base"),
    )
    return materialize(rows, "pii-spans")


def words_of(docs: DataFrame, text_col: str) -> DataFrame:
    """Every word of every text: text (its fingerprint), start and pieces (of its chunk), i (its place there), one, two (its patterns).

    Texts are cut into chunks of some 4000 characters, each with the words next to it, so that what is done
    with a word depends on its chunk and not on its text. All is one stage without an exchange."""
    empty = F.array(F.lit(""))
    rows = docs.select(text_of(text_col).alias("text"))

    def cut(chunks: Column) -> Column:
        starts = running(F.transform(chunks, F.length))
        return F.arrays_zip(chunks.alias("chunk"), starts.alias("start"), F.slice(F.concat(empty, chunks), F.lit(1), F.size(chunks)).alias("before"), F.slice(F.concat(chunks, empty), F.lit(2), F.size(chunks)).alias("after"))

    chunks = rows.select(_fingerprint(F.col("text")).alias("text"), F.explode(let(F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)), cut)).alias("c")).select("text", "c.*")
    tail = let(_cores(F.right("before", F.lit(400))), lambda c: F.array(_at(c, F.size(c) - 2), _at(c, F.size(c) - 1)))
    head = F.array(_at(_cores(F.left("after", F.lit(200))), F.lit(0)))
    # The cores of a chunk between those next to it: a word's are the second before to the first after it.
    around = F.concat(tail, _cores(F.col("chunk")), head)
    pieces = F.regexp_extract_all("chunk", F.lit(WORD), F.lit(0))  # made once a chunk, and only where they are asked for
    words = chunks.select("text", "start", pieces.alias("pieces"), around.alias("around")).select("text", "start", "pieces", "around", F.posexplode_outer("around").alias("i", "l2"))  # outer: no filter that would read the chunk twice is put before it
    words = words.where(F.col("i") < F.size("around") - 3)
    one, two = _patterns(F.col("l2"), F.get("around", F.col("i") + 1), F.get("around", F.col("i") + 3))
    return words.select("text", "start", "pieces", "i", one.alias("one"), two.alias("two"))


def _count(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n: the words that stand in each of `patterns`."""
    test = member_test(patterns, "pattern")
    seen = words.select(F.explode(F.array("one", "two")).alias("pattern")).where(test(F.col("pattern"))).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return patterns.join(seen.hint("merge"), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def _harvest(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """text, start, end, value, patterns of the words that stand in one of `patterns` (and of a few others)."""
    test = member_test(patterns, "pattern")
    pieces = words.where(test(F.col("one")) | test(F.col("two"))).withColumn("word", F.get("pieces", F.col("i")))
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    start = F.col("start") + before + F.length(F.regexp_extract("word", rf"^\s*+{_P}*+", 0))
    value = F.regexp_extract("word", WORD, 1)
    out = pieces.select("text", start.alias("start"), value.alias("value"), F.array("one", "two").alias("patterns")).where("value <> ''")
    return out.select("text", "start", (F.col("start") + F.length("value")).alias("end"), "value", "patterns").distinct()


def _free(harvest: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of harvest that touch no base span: both lie in the order of their text, and look to either side."""
    base = found.join(harvest.select("text").distinct().hint("merge"), "text", "left_semi").select("text", F.explode("base").alias("s"))
    base = base.select("text", F.col("s.start").alias("start"), F.col("s.end").alias("end")).distinct()
    both = base.withColumns({"value": F.lit(None).cast("string"), "patterns": F.lit(None).cast("array<string>")}).unionByName(harvest)
    # Both frames grow from the first row on, one of them in the reverse order: the others cost the square of a text's rows.
    on = [F.col("start"), F.col("value").isNotNull(), F.col("end")]
    one, back = Window.partitionBy("text").orderBy(*on), Window.partitionBy("text").orderBy(*[c.desc() for c in on])
    known = lambda c: F.when(F.col("value").isNull(), F.col(c))
    before = F.max(known("end")).over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(known("start")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumns({"before": before, "after": after}).where("value IS NOT NULL")
    return rows.where("coalesce(before, 0) <= start AND coalesce(after, end) >= end").drop("before", "after")


def bootstrap(docs: DataFrame, found: DataFrame, text_col: str, rounds: int = 3, support: int = 3, worth: float = 0.6, accept: float = 0.7) -> DataFrame | None:
    """text (fingerprint), kind, start, end of the words that contexts of base spans give away; None if no context does.

    A pattern needs `support` different values of one kind among its known instances, and is worth their
    share of all the words that stand in it (one more counted, against chance); a word is taken at a score of
    `accept`. No word is left out for its length, letters or digits. A round reads the texts twice, once to count the
    patterns that are new to it and once for the words of those that are worth it; rounds end where no pattern is new."""
    words = words_of(docs, text_col)
    spans = found.select(F.explode("base").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern")).where("pattern IS NOT NULL")
    # A value of several words isn't among the single words that stand in its pattern.
    several = F.when(F.startswith("pattern", F.lit("B:")) & F.col("value").rlike(r"\s"), 1).otherwise(0)
    known = spans.groupBy("pattern", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("score"), F.sum(several).alias("several"))
    known = materialize(known, "pii-known")
    counted, harvest, reaped, taken = None, None, None, None
    for _ in range(rounds):
        held = known
        if taken is not None:
            new = taken.select(F.explode("patterns").alias("pattern"), "kind", "value", "score").where("pattern IS NOT NULL")
            held = known.unionByName(new.withColumn("several", F.lit(0).cast("long"))).groupBy("pattern", "kind", "value").agg(F.sum("score").alias("score"), F.sum("several").alias("several"))
        strong = held.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.sum("several").alias("several"), F.count(F.lit(1)).alias("values"))
        strong = materialize(strong.where(F.col("values") >= support), "pii-strong")
        fresh = strong.select("pattern").distinct()
        if counted is not None:
            fresh = fresh.join(counted.hint("merge"), "pattern", "left_anti")
        fresh = materialize(fresh, "pii-fresh")
        if not fresh.isEmpty():
            seen = _count(words, fresh)
            counted = materialize(seen if counted is None else counted.unionByName(seen), "pii-counted")
        if counted is None:
            return None
        share = F.col("score") / (F.greatest(F.col("n") + F.col("several"), F.col("score")) + 1)
        good = materialize(strong.join(counted.hint("merge"), "pattern").withColumn("worth", share).where(F.col("worth") >= worth).select("pattern", "kind", "worth"), "pii-good")
        ripe = good.select("pattern").distinct()
        if reaped is not None:
            ripe = ripe.join(reaped.hint("merge"), "pattern", "left_anti")
        ripe = materialize(ripe, "pii-ripe")
        if ripe.isEmpty():
            break
        reaped = materialize(ripe if reaped is None else reaped.unionByName(ripe), "pii-reaped")
        more = _free(materialize(_harvest(words, ripe), "pii-harvest"), found)
        harvest = materialize(more if harvest is None else harvest.unionByName(more).distinct(), "pii-words")
        offers = harvest.select("text", "start", "end", F.explode("patterns").alias("pattern")).join(good.hint("merge"), "pattern")
        likely = offers.groupBy("text", "start", "end", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.least("worth", F.lit(0.999)))))).alias("score"))
        best = likely.groupBy("text", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("b")).where(F.col("b.score") >= accept)
        best = best.select("text", "start", "end", (-F.col("b.minus")).alias("kind"), F.col("b.score").alias("score"))
        taken = materialize(best.join(harvest.hint("merge"), ["text", "start", "end"]), "pii-taken")
    return None if taken is None else taken.select("text", "kind", "start", "end")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base and added (arrays of kind, start, end; by kind, then start).

    Positions are code points, ends exclusive; kinds number KINDS. Null texts are empty. Whole texts are
    read, equal texts give equal results, repeated rows and null ids are fine, extra columns are ignored, an empty
    table gives an empty result. Added spans are single words and never touch base spans."""
    found = find_spans(docs, id_col, text_col)
    added = bootstrap(docs, found, text_col)
    base = F.array_sort(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    if added is None:
        return found.select(F.col("id").alias(id_col), base.alias("base"), F.array().cast(_SPAN).alias("added"))
    added = added.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    out = spread_join(found, added, ["text"], ["id"], "left")
    return out.select(F.col("id").alias(id_col), base.alias("base"), F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
