"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its words. Words are ordered by rarity; two sets of Jaccard similarity 0.8 or more share a word within their
prefixes, and differ little in length, in the position of that word and in a 128-bit parity of their words. Lines for which some other line passes
these filters are joined once more, now with their whole sets, which decide; the later line goes. Both joins ask whether a partner exists, so that
neither gives pairs and a crowd of near copies costs each member the way to its first match.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import WORD, written

#: Word counts by hash, 2**18 of them whatever the corpus; they only order words, so that shared cells cost time, never a link.
CELLS_LOG = 18
#: Sets of more words have a parity of each half of their words, others of all their words together.
SHORT = 64
#: No character of a word.
_BLANK = r"[\x20\x09-\x0D]+"
#: Places, and ids of lines, are broadcast while they take at most so many bytes; beyond, both sides are shuffled.
SMALL = 64 << 20
#: Places in their order: documents by id, those of one id by a hash of their texts, and lines within them.
_PLACE = ("no_id", "did", "th", "line_no")


def _words(line: Column) -> Column:
    """The words of a line that has one, with repeats. Where single blanks part them, no pattern is needed, which is faster."""
    odd = reduce(or_, [F.contains(line, F.lit(c)) for c in ("\t", "\r", "\x0b", "\x0c", "  ")]) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _BLANK)).otherwise(F.split(line, " "))


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CELLS_LOG).cast("int")


def _rows(docs: DataFrame) -> DataFrame:
    """``(no_id, did, th, text)``: rows of one id and text are one document; a null id comes last and goes by its text."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), th).alias("did"), th.alias("th"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word, by hashes of its text: ``(h1, h2, no_id, did, line_no, th)``."""
    rows = _rows(docs).select("no_id", "did", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(WORD))
    return rows.select(F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "no_id", "did", "line_no", "th")


def _ranks(hashed: DataFrame) -> Column:
    """Ranks of word cells by the logarithm of their counts over all lines, in the upper 9 bits, as a scalar subquery of one array of fixed size."""
    words = hashed.select(F.explode("hashes").alias("h")).select(_cell(F.col("h")).alias("cell"))
    every = hashed.sparkSession.range(1 << CELLS_LOG).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("long").alias("n"))
    # words are counted before the union, which would end the compiled stage that takes the arrays apart
    counts = words.groupBy("cell").agg(F.count("*").alias("n")).unionByName(every).groupBy("cell").agg(F.sum("n").alias("n"))
    rank = F.shiftleft(F.floor(F.log2(F.col("n") + 1) * 4).cast("long"), 55)
    line = written(counts.select("cell", rank.alias("rank")).agg(F.sort_array(F.collect_list(F.struct("cell", "rank")))["rank"].alias("a")), "line-ranks")
    return line.scalar()


def rarity(docs: DataFrame) -> Column:
    """:func:`_ranks` of every line of ``docs``."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(WORD))
    return _ranks(_hashed(lines.select(F.lit(0).alias("id"), "line")))


def _by_doc(places: DataFrame, name: str) -> DataFrame:
    """Written ``(no_id, did, th, at)``: the lines of each document as an array of ``(line_no, id)``."""
    return written(places.groupBy("no_id", "did", "th").agg(F.collect_list(F.struct("line_no", "id")).alias("at")), name)


def _at_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(id, line)`` of the lines of ``docs`` at the written places of :func:`_by_doc`."""
    size = places.select(F.sum(F.size("at") * 16 + 64)).first()[0] or 0
    found = _rows(docs).join(F.broadcast(places) if size <= SMALL else places, ["no_id", "did", "th"])
    pick = F.transform("at", lambda k: F.struct(k["id"].alias("id"), F.get(F.col("lines"), k["line_no"]).alias("line")))
    # an array of one row makes the lines a column, which the function reads rather than splits anew
    return found.select(F.explode(F.array(F.split("text", "\n"))).alias("lines"), "at").select(F.inline(pick))


def _column(value: Column) -> Column:
    """``value`` as a column of its own: what Spark interprets, such as a lambda, then doesn't make it interpret the sorting and comparing around it."""
    return F.explode(F.array(value))


def _hashed(lines: DataFrame) -> DataFrame:
    """``(id, hashes)``: the hashes of the distinct words of each line."""
    return lines.select("id", _column(F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))).alias("hashes"))


def _keyed(hashed: DataFrame, ranks: Column) -> DataFrame:
    """``(id, keys)``: sorted 63-bit keys of the words of :func:`_hashed`, rarer words first, those of equal rank by their hash."""
    # never null, so that keys are sorted as plain numbers, also where the hashes were written and read
    key = lambda h: F.coalesce(F.get(F.col("ranks"), _cell(h)).bitwiseOR(F.shiftrightunsigned(h, 9)), F.lit(0).cast("long"))
    # two projections that become one: the ranks stay a reference within the expression and are no column of any row
    keyed = hashed.select("id", "hashes", ranks.alias("ranks")).select("id", F.transform("hashes", key).alias("keyed"))
    return keyed.select("id", _column(F.sort_array("keyed")).alias("keys"))


def _sets(lines: DataFrame, ranks: Column) -> DataFrame:
    return _keyed(_hashed(lines), ranks)


def _parity(keys: Column, half: bool = False) -> Column:
    """The exclusive or of one of 64 bits of each key, or of each key of one half; shifting takes a hash's lowest bits, in fewer steps a word than by masks and tables."""
    flip = lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(x)))
    step = (lambda acc, x: F.when(x.bitwiseAND(F.lit(64).cast("long")) == 0, acc).otherwise(flip(acc, x))) if half else flip
    return F.aggregate(keys, F.lit(0).cast("long"), step)


def _entries(sets: DataFrame) -> DataFrame:
    """A row for each prefix word of each set: ``(id, n, sig, sig2, pos, key)``; ``sig`` is the parity of all words, ``sig2`` of one half of them in sets of over ``SHORT`` words."""
    keys, n = F.col("keys"), F.size("keys")
    sig2 = F.when(n > SHORT, _parity(keys, half=True)).otherwise(F.lit(0).cast("long"))
    prefix = F.slice(keys, F.lit(1), n - F.floor((n * 4 + 4) / 5).cast("int") + 1)
    one = sets.select("id", n.alias("n"), _parity(keys).alias("sig"), sig2.alias("sig2"), prefix.alias("prefix"))
    # the condition is what the join adds, so that all uses share one exchange
    return one.select("id", "n", "sig", "sig2", F.posexplode("prefix").alias("pos", "key")).where("key is not null")


def _may_match(a: str, b: str) -> Column:
    """Length, positional and parity filters of two entries that share a prefix word."""
    col = lambda side, name: F.col(f"{side}.{name}")
    n, m, i, j = col(a, "n"), col(b, "n"), col(a, "pos"), col(b, "pos")
    total = n + m
    reach = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    differ = total - 2 * F.floor((total * 4 + 8) / 9)
    every, half = (col(a, c).bitwiseXOR(col(b, c)) for c in ("sig", "sig2"))
    unlike = F.when(F.least(n, m) > SHORT, F.bit_count(every.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(every))
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (reach * 9 >= total * 4) & (unlike <= differ)


def _same(a: str, b: str) -> Column:
    return F.size(F.array_intersect(f"{a}.keys", f"{b}.keys")) * 9 >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * 4


def near_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(id)`` of the written ``classes`` of lines that have an earlier similar one; ids rise with the first place.

    Lines are split and hashed once; their words are counted, and made keys of, from the written hashes.
    Entries that some other line's entry matches by the filters are what later steps work on. The rarest and the
    commonest of these of each line meet with whole sets first, which settles most copies. Lines still open are then held against every earlier line that the filters admit.
    """
    hashed = written(_hashed(_at_lines(docs, _by_doc(classes, "line-firsts"))), "line-words", plain=True)
    ranks = _ranks(hashed)
    entries = _entries(_keyed(hashed, ranks))
    meet = (F.col("x.key") == F.col("y.key")) & _may_match("x", "y")
    later = F.col("x.id") > F.col("y.id")
    x, y = entries.alias("x"), entries.alias("y")
    some = written(x.join(y, meet & (F.col("x.id") != F.col("y.id")), "left_semi"), "line-candidates", plain=True)
    ids = written(some.select("id").distinct(), "line-open")
    sets = written(_keyed(hashed.join(F.broadcast(ids) if ids.count() * 64 <= SMALL else ids, "id", "left_semi"), ranks), "line-sets", plain=True)
    rarest = some.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    few = some.join(rarest, "id").where("key = least or key = most").select(*some.columns).join(sets, "id").where("key is not null")
    x, y = few.alias("x"), few.alias("y")
    first = written(x.join(y, meet & later & _same("x", "y"), "left_semi").select("id").distinct(), "line-near")
    rest = some.join(first, "id", "left_anti").where("key is not null")
    x, y = rest.alias("x"), some.alias("y")
    x = written(x.join(y, meet & later, "left_semi"), "line-later")
    y = written(y.join(x.alias("x"), meet & later, "left_semi"), "line-earlier")
    x, y = x.join(sets, "id").alias("x"), y.join(sets, "id").alias("y")
    return first.unionByName(x.join(y, meet & later & _same("x", "y"), "left_semi").select("id").distinct())


def dropped_classes(docs: DataFrame) -> DataFrame:
    """``(h1, h2, no_id, did, th, line_no, near)`` of the distinct lines that occur twice or have an earlier similar line (``near``), with their first place."""
    first = _lines(docs).groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("o"), F.count("*").alias("times"))
    line = first.select("h1", "h2", "o.*", "times").repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    classes = written(line.withColumn("id", F.monotonically_increasing_id()), "line-classes", plain=True)
    near = near_lines(docs, classes).withColumn("near", F.lit(True))
    out = classes.join(near, "id", "left").where("times > 1 or near")
    return out.select("h1", "h2", *_PLACE, F.coalesce("near", F.lit(False)).alias("near"))


def gone_lines(docs: DataFrame) -> DataFrame:
    """Written ``(no_id, did, th, gone)``: the numbers of the lines that go, of each document that loses any."""
    order = F.struct(*_PLACE)
    drop = written(dropped_classes(docs).select("h1", "h2", order.alias("first"), "near"), "line-drops")
    gone = _lines(docs).join(drop, ["h1", "h2"]).where(F.col("near") | (order != F.col("first")))
    return written(gone.groupBy("no_id", "did", "th").agg(F.collect_set("line_no").alias("gone")), "line-gone")


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``n_lines``, ``n_removed`` unless ``counts`` is false.

    A line goes if an earlier line, in the order of (doc_id, line), equals it or has a word set of Jaccard similarity 0.8 or more; whether
    that line goes itself doesn't matter. Words are told apart by 63 bits of hash and rank. Lines without a word stay. Null texts stay null with no
    lines. Rows of the same doc_id and text are one document and stay alike; different texts of one doc_id go by a hash of the text; null doc_ids
    come last. Texts may be of any length. An empty table gives an empty one. Other columns pass through under any names, but for columns
    named like the two counts, which these replace.
    """
    gone = gone_lines(docs)
    size = gone.select(F.sum(F.size("gone") * 8 + 64)).first()[0] or 0
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), th).alias("did"), th.alias("th"))
    joined = own.join(F.broadcast(gone) if size <= SMALL else gone, ["no_id", "did", "th"], "left")
    split = joined.select("own", "gone", F.explode(F.array(F.split("own.text", "\n"))).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(kept)
    out = {c: (text if c == "text" else F.col(f"own.`{c}`")).alias(c) for c in docs.columns}
    if counts:
        number = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast(T.IntegerType())
        out |= {"n_lines": number("lines").alias("n_lines"), "n_removed": number("gone").alias("n_removed")}
    return split.select(*out.values())
