"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy over candidate strings.

The patterns give the base spans. The entropy method adds spans: a run of characters of one class (hexadecimal, upper
case with digits, lower case with digits, base 64) of at least WINDOW characters is a candidate; a window of WINDOW characters moves over it
with incremental counts (one character enters, one leaves, and the sum of n log2 n follows), and overlapping windows at
or above the class's threshold merge to a span. A second sum over the window's neighbouring characters, kept the same way,
tells words from random strings: pairs that words are made of count for, others, and changes between letters, digits and
case inside a run, against; a window that is too much like words is not taken, so paths, slugs and names stay. Candidates that an allow-list explains (words without digits, UUIDs,
those that placeholders leave too short, checksums named as such) are suppressed, and spans inside a base span are not repeated.

Positions are code points, end exclusive. They come from the lengths of the pieces between matches and of the matches.
Defined results: a null text is empty and has no spans; equal rows are scanned separately; an empty table gives an
empty result; extra columns are left out unless named in `more`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base kinds in the order in which they are listed, with the least length of what counts.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 6
#: Characters of a window; class of characters, least entropy of a window in bits, what else a candidate must hold, and the
#: most that a window may be like words (none: not asked). Chosen on random strings and on identifiers, paths and slugs:
#: see the README for what is missed and what is masked in vain.
WINDOW = 20
CLASSES = (("[0-9a-f]", 3.0, "[0-9]", None), ("[A-Z0-9]", 3.5, "[0-9]", -16), ("[a-z0-9]", 3.5, "[0-9]", -30), ("[A-Za-z0-9+/_=-]", 3.6, "", -36))
#: Fixed value: the commonest pairs of letters in English words.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"
    " ec el la ta et ac ho un us di pe tr no lo em ad ge po id ul il am pr ss im ig ut ct ca ot"
)
#: What a pair of neighbours counts: a common and another pair of letters, a capital after a small letter, two digits, a digit and a letter.
COMMON, RARE, RISE, DIGITS, MIXED = 5, -2, -7, 2, -7
#: Candidates that are no secrets; words that don't count, so that what is left must still fill a window; and what stands
#: before a candidate that is none.
ALLOWED = r"EXAMPLE(?:KEY)?$|^[0-9_=-]+$|(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOWED_WORDS = r"(?i)example|sample|placeholder|changeme|x{4,}|01234567|12345678|abcdefgh"
ALLOWED_BEFORE = r"(?i)(?:sha-?(?:1|256|384|512)|md5|checksum|digest|commit|etag)[^A-Za-z0-9]{0,3}$"
MASK = "[SECRET]"
#: Matches that are placed together: arrays only grow inside a batch, so that many matches cost little more than each one.
BATCH = 128
#: Characters before a candidate in which the allow-list looks for a name.
NEAR = 16

SPAN = "struct<start:int,kind:int,end:int>"


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value), with the value computed once however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches: start, end, before (16 characters before it or, if it follows a shorter match, fewer), value (of the group)."""
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.zip_with(pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("before"), m.alias("all"))),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda x, v: F.struct(F.right(x["before"], F.lit(NEAR)).alias("before"), F.length(x["before"]).alias("gap"), F.length(x["all"]).alias("n"), F.right(x["all"], F.lit(NEAR)).alias("tail"), v.alias("value")),
    )
    pairs = F.filter(pairs, lambda x: x["n"].isNotNull())
    span = "array<struct<start:int,end:int,before:string,value:string>>"
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    state = lambda at, tail, out: F.struct(at.alias("at"), tail.alias("tail"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        before = F.right(F.concat(acc["tail"], x["before"]), F.lit(NEAR))
        one = F.struct(start.alias("start"), (start + x["n"]).alias("end"), before.alias("before"), x["value"].alias("value"))
        return state(start + x["n"], x["tail"], F.concat(acc["out"], F.array(one)))

    def batch(acc: Column, some: Column) -> Column:
        placed = F.aggregate(some, state(acc["at"], acc["tail"], none(span)), step)
        return bound(placed, lambda p: state(p["at"], p["tail"], F.concat(acc["out"], F.array(p["out"]))))

    def placed(all_pairs: Column) -> Column:
        batches = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / BATCH).cast("int")), lambda i: F.slice(all_pairs, i * BATCH + 1, F.lit(BATCH)))
        found = F.aggregate(batches, state(F.lit(0), F.lit(""), none(f"array<{span}>")), batch, lambda acc: acc["out"])
        return F.when(F.size(all_pairs) > 0, F.flatten(found)).otherwise(none(span))

    return bound(pairs, placed)


def spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def base(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= LEAST_VALUE)
    return F.array_sort(F.concat(spans(assign, "assign"), spans(matches(text, ACCESS), "access"), spans(matches(text, HEX), "hex")))


def weight(n: Column) -> Column:
    """n log2 n, and 0 for 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def likeness(chars: Column, n: Column) -> Column:
    """What each character and the one before it count for being words; 0 for the first one and beside separators."""
    follow = F.array(*(F.lit("".join(p[1] for p in PAIRS.split() if p[0] == chr(97 + i))) for i in range(26)))

    def count(i: Column) -> Column:
        a, b = F.get(chars, i - 1), F.get(chars, i)
        of = lambda low, high: (lambda c: (c >= low) & (c <= high))
        small, large, digit = of("a", "z"), of("A", "Z"), of("0", "9")
        letter = lambda c: small(c) | large(c)
        known = F.contains(F.get(follow, F.ascii(F.lower(a)) - 97), b)
        both = F.when(small(b) & letter(a), F.when(known, COMMON).otherwise(RARE)).when(small(a) & large(b), RISE)
        return F.when(i == 0, 0).otherwise(both.when(digit(a) & digit(b), DIGITS).when(digit(a) & letter(b) | digit(b) & letter(a), MIXED).otherwise(0))

    return F.transform(F.sequence(F.lit(0), n - 1), count)


def hot(candidate: Column, least: float, most: int | None = None, window: int = WINDOW) -> Column:
    """The merged windows of a candidate whose entropy is `least` bits or more and that are like words by `most` at most, as (start, end).

    Windows hold `window` characters; entropy = log2(window) - sum(n log2 n) / window over the counts n.
    """
    n = F.length(candidate)
    words = lambda chars: F.array_repeat(F.lit(0), n) if most is None else likeness(chars, n)
    return bound(F.split(candidate, "", -1), lambda chars: bound(words(chars), lambda like: hot_chars(chars, like, n, least, most, window)))


def hot_chars(chars: Column, like: Column, n: Column, least: float, most: int | None, window: int) -> Column:
    empty = F.expr("named_struct('n', cast(map() as map<string,int>), 'sum', 0.0D, 'like', 0, 'out', cast(array() as array<struct<start:int,end:int>>))")

    def step(acc: Column, i: Column) -> Column:
        new, old = F.get(chars, i), F.get(chars, i - window)
        count = lambda m, c: F.coalesce(F.element_at(m, c), F.lit(0))
        put = lambda m, c, n: F.map_concat(F.map_filter(m, lambda k, _: k != c), F.when(n > 0, F.create_map(c, n)).otherwise(F.expr("cast(map() as map<string,int>)")))
        more = count(acc["n"], new)
        entered = F.struct(put(acc["n"], new, more + 1).alias("n"), (acc["sum"] - weight(more) + weight(more + 1)).alias("sum"))
        inside = acc["like"] + F.get(like, i) - F.when(i >= window - 1, F.get(like, i - window + 1)).otherwise(0)  # of the pairs that lie whole in the window

        def leave(e: Column) -> Column:
            less = count(e["n"], old)
            return F.struct(put(e["n"], old, less - 1).alias("n"), (e["sum"] - weight(less) + weight(less - 1)).alias("sum"))

        def judge(e: Column) -> Column:
            bits = F.lit(float(window)).cast("double")
            high = (i >= window - 1) & (F.log2(bits) - e["sum"] / bits >= least)
            high = high if most is None else high & (inside <= most)
            last = F.try_element_at(acc["out"], F.lit(-1))
            touching = F.coalesce(last["end"] >= i - window + 1, F.lit(False))
            one = F.array(F.struct(F.when(touching, last["start"]).otherwise(i - window + 1).alias("start"), (i + 1).alias("end")))
            kept = F.when(touching, F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(acc["out"])
            return F.struct(e["n"].alias("n"), e["sum"].alias("sum"), inside.alias("like"), F.when(high, F.concat(kept, one)).otherwise(acc["out"]).alias("out"))

        with_left = F.transform(F.array(entered), lambda e: F.when(i >= window, leave(e)).otherwise(e))
        return F.get(F.transform(with_left, judge), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), empty, step, lambda acc: acc["out"])


def class_spans(text: Column, chars: str, least: float, needed: str, most: int | None, window: int) -> Column:
    """The entropy spans of candidates of one class of characters."""
    beside = "[A-Za-z0-9]"
    candidates = F.filter(
        matches(text, rf"(?<!{beside}){chars}{{{window},}}+(?!{beside})"),
        lambda x: x["value"].rlike(needed) & ~x["value"].rlike(ALLOWED) & (F.length(F.regexp_replace(x["value"], ALLOWED_WORDS, "")) >= window) & ~x["before"].rlike(ALLOWED_BEFORE),
    )

    def placed(x: Column) -> Column:
        kind = F.lit(KINDS.index("entropy")).alias("kind")
        return F.transform(hot(x["value"], least, most, window), lambda h: F.struct((x["start"] + h["start"]).alias("start"), kind, (x["start"] + h["end"]).alias("end")))

    return F.flatten(F.transform(candidates, placed))


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*(class_spans(text, *c, window) for c in CLASSES))))


def scan(documents: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, `more`, base and added: sorted arrays of (start, kind number in KINDS, end)."""
    text = F.col("text")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    maybe = text.rlike(rf"{ACCESS}|{HEX}|[A-Za-z0-9+/_=-]{{{WINDOW}}}|{ASSIGN}")
    out = common.texts(documents, *more).withColumn("base", F.when(maybe, base(text)).otherwise(none))
    out = out.withColumn("found", F.when(maybe, entropy_spans(text)).otherwise(none))
    apart = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return out.withColumn("added", apart).drop("found")


def shown(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")


def redact(documents: DataFrame, more: tuple[str, ...] = (), mask: str = MASK) -> DataFrame:
    """doc_id, text, `more`, with every span (overlapping ones as one) replaced by the mask."""
    every = F.array_sort(F.concat("base", "added"))
    step = lambda acc, x: F.when(
        x["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)).alias("out"), x["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))
    hidden = F.aggregate(every, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    held = tuple(f"_more_{i}" for i, _ in enumerate(more))
    rows = scan(documents.select("doc_id", "text", *(F.col(c).alias(h) for c, h in zip(more, held))), held)
    return rows.select("doc_id", F.when(F.size(every) > 0, hidden).otherwise(F.col("text")).alias("text"), *(F.col(h).alias(c) for c, h in zip(more, held)))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.concat("base", "added")).alias("spans"))
