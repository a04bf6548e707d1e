"""Line deduplication by a deletion-neighbourhood join (SQL functions only).

Two lines are duplicates if their words are equal, or if both have at least
``MIN_WORDS`` words and their word sequences are at most one edit apart (one
word put in, left out or replaced).  A line goes if an equal or near line
comes earlier, by (doc_id, line number); the earliest stays.

Edits are found as in symmetric deletion: the variants of a line are the
whole line and the line without each one of its words.  A replaced word means
both lines agree without their words at the same position; a word put in
means one whole line equals the other without a word.  Variants travel as
hashed keys, keys meet in aggregations, and the edit distance of each pair so
found is verified on the words themselves.

How it runs on Spark:

* lines collapse to distinct lines first, so a line that occurs in a third
  of all documents costs one row after the partial aggregation;
* cut the shorter of two lines one edit apart into three parts: the edit leaves
  two of them as they are, so the lines agree in the first two parts, the last
  two or the outer two.  Only lines whose two parts occur in another line emit
  variants.  This loses nothing and spares the other lines; most of
  them are told apart by a bitmap of fixed size, without a join;
* a variant's key is a sum of word hashes: prefix sum plus shifted suffix sum,
  so a line of n words costs n additions, not n copies of itself;
* the two joins with whole texts are merge joins at every size, so work and disk
  grow in proportion to the input;
* no group is compared pair by pair: lines that share a key need only the
  earliest among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple.llm.common import partitions, stored

MIN_WORDS = 8
SPACE = r"[\x20\x09-\x0D]+"
BITMAP_BITS = 24                # 2**18 words of 64 bits
MASK = (1 << 42) - 1            # sums of up to 2**20 masked hashes fit 64 bits


def words_of(line):
    # words with one space between them are by far the most frequent and need no regular expression
    odd = line.startswith(" ") | line.endswith(" ") | (line == "")
    for c in ("  ", "\t", "\r", "\x0b", "\x0c", "\n"):
        odd |= line.contains(c)
    return F.when(odd, F.filter(F.split(line, SPACE, -1), lambda w: w != "")).otherwise(F.split(line, " ", -1))


def _key(words):
    """128 bits that name a word sequence."""
    return F.unhex(F.md5(F.array_join(words, " ").cast("binary")))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, line, words`` of every line that has words."""
    text = F.col(text_col).cast("string")
    lines = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"),
                                                F.posexplode(F.split(text, "\n", -1)).alias("line", "l"))
    # generated: later columns meet a finished array, not an expression to run again for each
    return lines.select("doc_id", "row", "line", F.explode(F.array(words_of(F.col("l")))).alias("words")).where(
        F.size("words") > 0)


def _shared_parts(words):
    """Keys of two parts out of three, of t words each, for t a third of the length, and of the length less one.

    The shorter of two lines one edit apart has n words, t = n div 3: the edit leaves the
    first 2t words, the last 2t or the first and last t as they are.
    """
    n = F.size(words)
    t = F.floor(n / 3).cast("int")
    part = lambda side, a, b: F.xxhash64(F.lit(side), F.slice(words, 1, a), F.slice(words, n - b + 1, b))
    keys = lambda t: F.array(part("outer", t, t), part("first", 2 * t, F.lit(0)), part("last", F.lit(0), 2 * t))
    thirds = F.when(n < MIN_WORDS, F.array().cast("array<int>")).when(
        (n > MIN_WORDS) & (n % 3 == 0), F.array(t, t - 1)).otherwise(F.array(t))
    # a lambda keeps the generated code short: one long method for all keys would never be compiled
    return F.flatten(F.transform(thirds, keys))


def _variants(lines: DataFrame) -> DataFrame:
    """``id, gap, at_gap, any_gap`` of lines(id, words): hashed keys of the whole line and of each deletion.

    ``gap`` is the position of the word left out (-1: the whole line); it is
    part of the key ``at_gap`` and not of ``any_gap``.
    """
    dealt = lines.repartition(partitions(lines.sparkSession), "id")      # a line's words stay in one partition
    words = dealt.select("id", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    hashed = words.select("id", "n", "i", *(
        F.xxhash64(F.lit(s), F.col("w"), F.col("i") - F.lit(back)).bitwiseAND(F.lit(MASK)).alias(f"{name}{back}")
        for s, name in ((0, "a"), (1, "b")) for back in (0, 1)))
    total = Window.partitionBy("id")
    upto = total.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # words in front of the gap keep their place, words behind it move up by one
    less = hashed.select("id", (F.col("n") - 1).alias("left"), F.col("i").alias("gap"), *(
        (F.sum(f"{c}0").over(upto) - F.col(f"{c}0") + F.sum(f"{c}1").over(total) - F.sum(f"{c}1").over(upto)).alias(c)
        for c in "ab"))
    whole = hashed.groupBy("id").agg(F.max("n").alias("left"), F.lit(-1).alias("gap"),
                                     F.sum("a0").alias("a"), F.sum("b0").alias("b"))
    return less.unionByName(whole).select("id", "gap", F.xxhash64("left", "a", "b", "gap").alias("at_gap"),
                                          F.xxhash64("left", "a", "b").alias("any_gap"))


def one_edit(x, y):
    """True if the word arrays are at most one edit apart."""
    short, long_ = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    same = lambda p, q: F.coalesce(
        F.nullif(F.array_position(F.zip_with(p, q, lambda u, v: u.eqNullSafe(v)), False),
                 F.lit(0)) - 1, short)
    head = same(x, y)
    tail = F.least(same(F.reverse(x), F.reverse(y)), short - F.least(head, short))
    return (long_ - F.least(head, short) - tail) <= 1


def _meeting(parts: DataFrame) -> DataFrame:
    """``part``: keys of two parts that occur in two different lines of parts(k, parts)."""
    each = parts.select("k", F.explode("parts").alias("part"))
    return stored(each.groupBy("part").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y").select("part"),
                  "meeting")


def _able(occurrences: DataFrame) -> DataFrame:
    """``id, key, first`` of the distinct lines one of whose parts meets; ids follow the first occurrence.

    The meeting parts as a bitmap of fixed size (2**BITMAP_BITS bits, so the
    broadcast has a bound) keep most lines out of the join; what it lets through by
    chance goes there.
    """
    meeting = _meeting(occurrences.select(F.xxhash64("key").alias("k"), "parts"))
    place = F.col("part").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(part & 63 as int))")
    bits = meeting.groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits"))
    each = occurrences.select("key", "doc_id", "row", "line", F.explode("parts").alias("part"))
    hits = each.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("at")).where(
        F.col("bits").bitwiseAND(bit) != 0)
    first = hits.join(meeting, "part", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"))
    # numbers in the order of first occurrence: smaller is earlier
    return stored(first.orderBy("first").select(F.monotonically_increasing_id().alias("id"), "key", "first"), "able")


def _fetched(texts: DataFrame, able: DataFrame) -> DataFrame:
    """``id, words`` of able(id, first), from texts(doc_id, row, text): the texts are shuffled once, not their words."""
    wanted = able.select("first.doc_id", "first.row", F.struct("first.line", "id").alias("x")).groupBy(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list("x").alias("wanted")).hint("merge")
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select(
        "wanted", F.split("text", "\n", -1).alias("lines"))
    picked = F.when(F.size("lines") > 0, F.transform("wanted", lambda x: F.struct(
        x["id"].alias("id"), F.get(F.col("lines"), x["line"]).alias("l"))))
    return (joined.select(F.explode(picked).alias("x")).groupBy("x.id").agg(F.any_value("x.l").alias("l"))
            .select("id", words_of(F.col("l")).alias("words")))


def nearest_earlier(occurrences: DataFrame, texts: DataFrame) -> DataFrame:
    """``key`` of occurrences(doc_id, row, line, key, parts): the lines with an earlier line one edit away."""
    able = _able(occurrences)
    fetched = stored(_fetched(texts, able), "words")
    variants = stored(_variants(fetched), "variants")
    deleted = variants.where("gap >= 0")
    # a word replaced: both lines without the word at one position
    least = deleted.groupBy("at_gap").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p < q").drop("q")
    replaced = deleted.join(least, "at_gap").where("p < id").select("id", "p")
    # a word put in: a whole line equals a longer one without a word
    whole = variants.where("gap < 0").select("any_gap", F.col("id").alias("p"))
    put_in = deleted.join(whole, "any_gap").where("id <> p").select(
        F.greatest("id", "p").alias("id"), F.least("id", "p").alias("p"))
    pairs = replaced.unionByName(put_in).groupBy("id").agg(F.min("p").alias("p"))
    other = fetched.select(F.col("id").alias("p"), F.col("words").alias("_w"))
    verified = pairs.join(fetched, "id").join(other, "p").where(
        (F.size("words") >= MIN_WORDS) & (F.size("_w") >= MIN_WORDS) & one_edit(F.col("words"), F.col("_w")))
    return able.select("id", "key").join(verified.select("id"), "id").select("key")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, line, near`` of each line that goes; ``row`` is a hash of the document's text."""
    lines = line_rows(docs, id_col, text_col)
    occurrences = stored(lines.select("doc_id", "row", "line", _key(F.col("words")).alias("key"),
                                      _shared_parts(F.col("words")).alias("parts")), "lines")
    first = F.min(F.struct("doc_id", "row", "line")).alias("first")
    distinct = occurrences.groupBy("key").agg(first, F.count(F.lit(1)).alias("n"))
    text = F.col(text_col).cast("string")
    texts = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"),
                                                text.alias("text"))
    near = stored(nearest_earlier(occurrences, texts), "near")
    # only lines that occur again or have a near earlier line decide anything
    decided = distinct.join(near.select("key", F.lit(True).alias("near")), "key", "left").select(
        "key", "first", "n", F.coalesce("near", F.lit(False)).alias("near")).where("near or n > 1")
    here = F.struct("doc_id", "row", "line")
    return (occurrences.select("doc_id", "row", "line", "key").join(decided, "key")
            .where(F.col("near") | ~here.eqNullSafe(F.col("first")))
            .select("doc_id", "row", "line", "near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text rebuilt from its kept lines, plus four counts.

    Added: ``_n_lines``, ``_n_exact``, ``_n_near`` (lines dropped as equal to, or
    near, an earlier one) and ``_kept`` (text of the kept lines).  Lines are
    split at ``\\n``; blank lines always stay.  A null text stays null (no
    lines).  Rows equal in id and text share their fate: their lines count as
    the same place.  Null ids sort first.  An empty table gives an empty one.
    Columns of ``docs`` are carried along; names that begin with ``_`` are taken.
    """
    drops = dropped_lines(docs, id_col, text_col)
    drops = drops.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.array_sort(F.collect_set(F.struct("line", "near"))).alias("x"))
    # a letter for each line up to the last that goes; made from neighbours, so no lambda holds a whole array
    lines_of = F.col("x.line")
    before = F.concat(F.array(F.lit(-1)), F.slice(lines_of, 1, F.size(lines_of) - 1))
    marks = F.array_join(F.zip_with(lines_of, before, lambda i, p: F.concat(F.repeat(F.lit("k"), i - p - 1), F.lit("g"))), "")
    drops = drops.select("_id", "_row", marks.alias("_marks"), F.size("x").alias("_n_gone"),
                         F.size(F.filter("x", lambda d: d["near"])).cast("long").alias("_near")).hint("merge")
    text = F.col(text_col).cast("string")
    rows = docs.withColumn("_own", F.xxhash64(text))
    joined = rows.join(drops, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_row")), "left")
    lines = F.split(text, "\n", -1)
    # the letters beside the lines: lines behind the last letter stay
    letters = F.split(F.rpad("_marks", F.size(lines), "k"), "")
    beside = F.filter(F.arrays_zip(lines.alias("line"), letters.alias("mark")), lambda x: x["mark"] == "k")
    kept = F.array_join(F.transform(beside, lambda x: x["line"]), "\n")
    near = F.coalesce("_near", F.lit(0).cast("long"))
    return joined.select(
        *(F.col(c) for c in docs.columns),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_n_lines"),
        (F.coalesce("_n_gone", F.lit(0)) - near).cast("long").alias("_n_exact"), near.alias("_n_near"),
        F.when(F.col("_marks").isNull(), text).otherwise(kept).alias("_kept"))
