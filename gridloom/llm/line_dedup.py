"""Line deduplication across documents by a deletion-neighbourhood join.

A line is a piece of a text between newlines; its words are what lies between white space. Lines with the same words
are equal. Lines of at least MIN_WORDS words are also near each other if one word put in, taken out or replaced
turns one into the other (with five words, one edit leaves four fifths of a line, so shorter lines are never near). A
line goes if it equals an earlier line, or is near an earlier line (all lines are judged on the input, not on what is
left). Earlier: smaller doc_id, then smaller hash of the text, then smaller line number.

Steps, all DataFrame operations:
1. Each line gets a hashed key of its words. Lines that share a key are compared by their words; where several texts
   have one key, each text is a class (key, sub) of its own. The earliest line stands for its class.
2. Two near lines share the first or the last half of the shorter one. Lines that share no half with another line
   have no near line and go no further; this loses nothing.
3. The rest emit a hashed key for each line with one word deleted, and one for the whole line (sums of word-and-place
   hashes, so a line of n words costs n steps). Keys are grouped by aggregates, so no pairs are made.
4. For the members of groups of several classes the edit is verified on the words: lines that are equal without their
   words at one place differ in that word only; a line that is another without one word has one word less. The earliest
   of each verified group is the evidence for the others. Hashes choose what is compared and decide nothing.

Lines without words always stay. Null text is empty text. Rows with the same doc_id and the same text count as one
document, and all of them get its result (texts of one doc_id are told apart by a 64-bit hash). A null doc_id comes
before any other. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, documents, materialize, skew_safe_left_join, small

MIN_WORDS = 5
#: Bits of a word-and-place hash: sums over a million words stay within a long.
_BITS = 40
#: Bits of the key of a line.
_KEY_BITS = 64
#: Members of a group that one copy of its earliest line serves.
_SHARE = 10_000
_PLACE = ("doc_id", "text_hash", "line")
_CLASS = ("key", "sub")


def _normal(text: Column) -> Column:
    """The text with the words of each line joined by one space. Only texts that need it go through patterns."""
    odd = text.startswith(" ") | text.endswith(" ")
    for piece in ("  ", " \n", "\n ", "\t", "\r", "\f", "\x0b"):
        odd = odd | text.contains(piece)
    joined = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " "), " ?\\n ?", "\n")
    return F.when(odd, F.trim(joined)).otherwise(text)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line, words (joined by a space), key for each line with words."""
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split(_normal(F.col("text")), "\n")).alias("line", "words")).where("words <> ''")
    return lines.withColumn("key", F.shiftrightunsigned(F.xxhash64("words"), 64 - _KEY_BITS) if _KEY_BITS < 64 else F.xxhash64("words"))


def _count(words: Column) -> Column:
    return F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the first and last halves that a near line must share with this one, as its shorter and longer side."""
    some = lambda m: F.call_function("substring_index", words, F.lit(" "), m.cast("int"))
    m = F.floor(n / 2)
    own = [F.xxhash64(some(m), F.lit(0)), F.xxhash64(some(-m), F.lit(1))]
    less = [F.xxhash64(some(m - 1), F.lit(0)), F.xxhash64(some(1 - m), F.lit(1))]
    return F.when(n % 2 == 1, F.array(*own)).otherwise(F.array(*own, *less))


def _classes(docs: DataFrame, marks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of the wanted keys (key, sub, words, open), and marks with the sub of each line's class."""
    seen = _lines(docs).select("key", "words").join(small(wanted), "key").groupBy("key", "words", "open").agg(F.count(F.lit(1)).alias("n"))
    texts = materialize(seen.select("key", "words", "open"), "line-texts")
    several = materialize(texts.groupBy("key").count().where("count > 1").select("key"), "line-several")
    if several.isEmpty():
        return texts.withColumn("sub", F.lit(0)), marks.withColumn("sub", F.lit(0))
    few = small(several.withColumn("several", F.lit(True)))
    order = F.row_number().over(Window.partitionBy("key").orderBy("words")) - 1
    told = materialize(texts.join(few, "key").select("key", "words", order.alias("sub")), "line-told")
    again = _lines(docs).join(few, "key").select(*_PLACE, "key", "words").join(told, ["key", "words"]).select(*_PLACE, "key", "sub")
    alone = texts.join(few, "key", "left_anti").select("key", "words", "open", F.lit(0).alias("sub"))
    # Lines of one key that are not equal may be near each other, whatever their halves say of the key.
    texts = alone.union(told.select("key", "words", F.lit(True).alias("open"), "sub"))
    marks = marks.select(*_PLACE, "key", F.lit(0).alias("sub")).join(few, "key", "left_anti").select(*_PLACE, *_CLASS).union(again.select(*_PLACE, *_CLASS))
    return materialize(texts, "line-texts"), materialize(marks, "line-marks")


def _variants(lines: DataFrame) -> DataFrame:
    """For each line (key, sub, first, words), a row for each word left out (at) and one for the whole (at -1), with its hash and the words of the longer line."""
    by_line = Window.partitionBy(*_CLASS).orderBy("at")
    token = lines.select(*_CLASS, "first", F.posexplode(F.split("words", " ")).alias("at", "word"))
    hashed = lambda at: F.shiftrightunsigned(F.xxhash64("word", at), 64 - _BITS)
    token = token.select(*_CLASS, "first", "at", hashed(F.col("at")).alias("here"), hashed(F.col("at") - 1).alias("moved"), F.xxhash64("word").alias("word"))
    every = by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("here").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    moved = F.sum("moved").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    token = token.select(
        *_CLASS, "first", "at", (upto - F.col("here") + F.sum("moved").over(every) - moved).alias("hash"), upto.alias("whole"), F.count(F.lit(1)).over(every).cast("int").alias("n"),
        # Of equal words side by side, taking out any one gives the same line.
        F.coalesce(F.lead("word").over(by_line) != F.col("word"), F.lit(True)).alias("last"),
    )
    one = F.struct("at", F.col("hash"), F.col("n").alias("longer"), F.col("last"))
    whole = F.struct(F.lit(-1).alias("at"), F.col("whole").alias("hash"), (F.col("n") + 1).alias("longer"), F.lit(True).alias("last"))
    both = F.when(F.col("at") == F.col("n") - 1, F.array(one, whole)).otherwise(F.array(one))
    return token.select(*_CLASS, "first", F.explode(both).alias("v")).select(*_CLASS, "first", "v.*")


def _members(variants: DataFrame, by: list[str], holds: Column) -> DataFrame:
    """The rows of groups that hold something to verify, and c, the size of the group."""
    sizes = variants.groupBy(*by).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in (*_CLASS, "at") for f in (F.min, F.max)], F.count(F.lit(1)).alias("c"))
    sizes = materialize(sizes.where(holds).select(*by, "c"), "line-groups")
    if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return variants.join(F.broadcast(sizes), by)
    return skew_safe_left_join(variants, sizes, by, "c", variants.count()).where("c IS NOT NULL")


def _verified(members: DataFrame, texts: DataFrame, by: list[str], best: dict[str, Column], evidence: Column) -> DataFrame:
    """The classes for which the earliest lines of their group, equal without the word, are evidence."""
    words = F.split("words", " ")
    rest = F.when(F.col("at") < 0, F.col("words")).otherwise(F.concat_ws(" ", F.slice(words, F.lit(1), F.col("at")), F.slice(words, F.col("at") + 2, F.size(words))))
    rows = materialize(members.join(texts.select(*_CLASS, "words"), list(_CLASS)).withColumn("rest", rest).drop("words"), "line-members")
    shares = F.ceil(F.col("c") / _SHARE).cast("int")
    on = [*by, "c", "rest"]
    found = rows.groupBy(*on).agg(*[c.alias(n) for n, c in best.items()])
    found = found.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    rows = rows.withColumn("share", F.pmod(F.xxhash64(*_CLASS), shares).cast("int"))
    return rows.join(found, [*on, "share"]).where(evidence).select(*_CLASS)


def line_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, line, near for each line that goes; near: only an edited form of it came earlier."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    lines = _lines(own).withColumn("n", _count(F.col("words")))
    marks = lines.select(*_PLACE, "key", F.when(F.col("n") >= min_words, _halves(F.col("words"), F.col("n"))).alias("halves"))
    marks = materialize(marks, "line-marks")
    total = marks.count()

    halves = marks.select("key", F.explode("halves").alias("half"))
    shared = materialize(halves.groupBy("half").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("half"), "line-halves")
    open_keys = halves.join(small(shared), "half", "left_semi").select("key", F.lit(True).alias("open"))
    repeated = marks.groupBy("key").count().where("count > 1").select("key", F.lit(False).alias("open"))
    wanted = materialize(open_keys.union(repeated).groupBy("key").agg(F.max("open").alias("open")), "line-wanted")

    texts, marks = _classes(own, marks.drop("halves"), wanted)
    place = F.struct(*_PLACE)
    firsts = marks.join(small(wanted.select("key")), "key", "left_semi").groupBy(*_CLASS).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("seen"))
    firsts = materialize(firsts, "line-firsts")

    able = texts.where("open").where(_count(F.col("words")) >= min_words).select(*_CLASS, "words")
    variants = materialize(_variants(able.join(firsts.drop("seen"), list(_CLASS))), "line-variants")
    put = ["hash", "longer"]
    same_place = _members(variants.where("at >= 0"), [*put, "at"], F.expr("min_key <> max_key OR min_sub <> max_sub"))
    replaced = _verified(same_place, able, [*put, "at"], {"early": F.min("first")}, F.expr("early < first"))
    sides = _members(variants.where("last"), put, F.expr("min_at < 0 AND max_at >= 0"))
    best = {"early_whole": F.min(F.when(F.col("at") < 0, F.col("first"))), "early_cut": F.min(F.when(F.col("at") >= 0, F.col("first")))}
    put_in = _verified(sides, able, put, best, F.expr("CASE WHEN at < 0 THEN early_cut < first ELSE early_whole < first END"))
    near = replaced.union(put_in).distinct().withColumn("near", F.lit(True))

    state = firsts.join(near, list(_CLASS), "left").where("seen > 1 OR near").select(*_CLASS, "first", F.coalesce("near", F.lit(False)).alias("near_first"), "seen")
    state = materialize(state, "line-state")
    found = skew_safe_left_join(marks.select(*_PLACE, *_CLASS), state, list(_CLASS), "seen", total).where(F.col("seen").isNotNull())
    equal = ~place.eqNullSafe(F.col("first"))
    return found.where(equal | F.col("near_first")).select(*_PLACE, (~equal).alias("near")).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_equal, n_near (lines that go), removed (their numbers from 0, sorted), kept_text."""
    gone = line_findings(docs, id_col, text_col, min_words).groupBy("doc_id", "text_hash").agg(
        F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_list("line")).alias("removed")
    )
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_equal", "n_near", "removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), (newlines + 1).cast("long").alias("n_lines"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["hash"] == gone["__hash"]), "left")
    gone_lines = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(gone_lines, i)), "\n")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_lines", zero("n_equal"), zero("n_near"), gone_lines.alias("removed"), kept.alias("kept_text"))


def query(spark, sf_dir):
    found = line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_equal", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
l AS (SELECT doc_id, line, list_filter(string_split_regex(raw, '[ \t\r\f\x0B]+'), lambda w: w <> '') AS w FROM raw),
e AS (SELECT w, min((doc_id, line)) AS first FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT first, w, unnest(range(len(w))) AS p FROM e WHERE len(w) >= 5),
k AS (SELECT first, p, w[1:p] || w[p + 2:len(w)] AS cut FROM v),
near AS (
  SELECT a.first FROM k a JOIN (SELECT cut, p, min(first) AS other FROM k GROUP BY cut, p) b USING (cut, p) WHERE b.other < a.first
  UNION SELECT a.first FROM k a JOIN e b ON a.cut = b.w WHERE len(b.w) >= 5 AND b.first < a.first
  UNION SELECT b.first FROM k a JOIN e b ON a.cut = b.w WHERE len(b.w) >= 5 AND a.first < b.first
),
r AS (SELECT l.doc_id, l.line, (l.doc_id, l.line) = e.first AS near FROM l JOIN e ON l.w = e.w
      WHERE (l.doc_id, l.line) <> e.first OR e.first IN (SELECT first FROM near)),
g AS (SELECT doc_id, count(*) FILTER (NOT near) AS n_equal, count(*) FILTER (near) AS n_near,
      string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed_lines FROM r GROUP BY doc_id)
SELECT documents.doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, coalesce(n_equal, 0) AS n_equal,
  coalesce(n_near, 0) AS n_near, coalesce(removed_lines, '') AS removed_lines
FROM documents LEFT JOIN g USING (doc_id)
"""
