"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line's tokens are its different words; a line without words is never matched and stays. A line goes if an
earlier one (by doc_id, null last, then place in the text) has the same words in the same order, or a Jaccard
similarity of at least 0.8 on the sets of words. Equal lines are joined first, by 128-bit hashes of their
words, which meet in small rows; the lines themselves are written once and stay where they are. Of the different
lines that are left:

- tokens are ordered by rarity: how often their hash bucket (of BUCKETS) occurs in these lines, then by hash;
- two similar lines share a token in the first n - ceil(0.8 n) + 1 of each (prefix filter); tokens that only
  one line has in its prefix are dropped, at the others lines meet;
- a pair must fit in length, from the place where it meets enough tokens must follow in both (positional filter, at
  the first token that the two share), and the parities of its tokens' hash bits must not differ in more bits than the pair may differ in
  tokens (a bitmap filter: a token that one line has alone turns one bit);
- pairs that are left are verified on the words themselves.

That there is an earlier similar line is what decides, so pairs need not all be made: every line first meets
the earliest line of each of its prefix tokens, which settles groups of near copies; lines that this leaves
meet all earlier ones at all prefix tokens, and all filters are conditions of that join.

Cases: null texts count as empty (one line without words); lines of rows that share a doc_id at the same
place don't remove each other, so repeated rows are treated alike. A text of any length is cut into its
lines, and a line may be the whole text; tokens of one line are the most that one row holds. An empty table
gives an empty result. Only doc_id and text are read; columns whose names differ from these do not matter.
"""

from __future__ import annotations

from functools import reduce
from math import log2
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, own, written

PERCENT = 80
#: Buckets of token counts: a table of fixed size, which every task gets.
BUCKETS = 1 << 16
LAST = 2**63 - 1
#: White space beside spaces and line feeds.
OTHERS = "\t\x0b\x0c\r"
#: Of a line: dk, its place and th.
KEY = ("dk", "no", "th")
#: Of a line at a token: dk; no and th in one long; n, i and whether it is done in one long (dealt()); parities of the line.
POST = ("dk", "nt", "at", "bits", "half")
#: From so many tokens on a line has parities of 128 bits: the 64 of any two long lines may differ by chance as little.
LONG = 64
#: The low bits of a token are those of its hash; the bits above have its rarity.
LOW = 56
#: Posts for each partition of them, about, and the least and most partitions.
PARTITION, LEAST, PARTITIONS = 200_000, 16, 100_000
#: Lines whose keys may be broadcast to look them up, at most.
LOOKED_UP = 500_000


def ids_repeat(docs: DataFrame) -> bool:
    """Whether rows share a doc_id, or several have none."""
    return not docs.groupBy(own(docs, "doc_id").cast("long").alias("dk")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 OR dk IS NULL OR dk = " + str(LAST)).isEmpty()


def rows_of(docs: DataFrame, repeat: bool = True) -> DataFrame:
    """doc_id, text, and dk and th, which order rows and tell those of one doc_id apart, where doc_ids repeat."""
    doc_id, text = own(docs, "doc_id").cast("long"), F.coalesce(own(docs, "text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("dk"), (F.hash(text, F.xxhash64(text)) if repeat else F.lit(0)).alias("th"), text.alias("text"))


def spaced(text: str) -> Column:
    """A text or line with spaces for the other white space but line feeds; texts without any are not gone through again."""
    out = F.col(text)
    others = [F.contains(out, F.lit(space)) for space in OTHERS]
    for space in OTHERS:
        out = F.replace(out, F.lit(space), F.lit(" "))
    return F.when(reduce(or_, others), out).otherwise(F.col(text))


def squeezed(line: Column) -> Column:
    """The words of a spaced line with one space between them."""
    # Each space becomes two marks, which are no longer in the line; marks between spaces go, and two are a space again.
    once = line
    for old, new in ((" ", "\x0b\x0c"), ("\x0c\x0b", ""), ("\x0b\x0c", " ")):
        once = F.replace(once, F.lit(old), F.lit(new))
    return F.btrim(F.when(F.contains(line, F.lit("  ")), once).otherwise(line))


def plain(line: str) -> Column:
    """The words of a line with one space between them."""
    return squeezed(spaced(line))


def words(line: str) -> Column:
    """The words of a plain line, repeats included."""
    return F.split(line, " ")


def lines_of(rows: DataFrame) -> DataFrame:
    """dk, no, th, line (plain), and a, b (two hashes of its words) of every line with words."""
    cut = rows.select("dk", "th", spaced("text").alias("text")).select("dk", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    cut = cut.filter(F.btrim("line") != "").withColumn("line", squeezed(F.col("line")))
    return cut.select(*KEY, "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def rarities(classes: DataFrame) -> Column:
    """An array of BUCKETS longs: the logarithm of how often tokens of a bucket occur, in the bits above LOW."""
    tokens = classes.select(F.explode_outer(words("line")).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"))
    ranks = [0] * BUCKETS
    for r in tokens.groupBy("bucket").count().collect():  # BUCKETS rows at most
        ranks[r["bucket"]] = int(2 * log2(r["count"]))
    # One string, made into an array once, when the plan is optimised.
    return F.split(F.lit(",".join(str(x << LOW) for x in ranks)), ",").cast("array<long>")


def packed() -> Column:
    """nt: no and th in one long, in their order."""
    return F.shiftleft(F.col("no").cast("long"), 32).bitwiseOR(F.col("th").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("nt")


def prefixes_of(classes: DataFrame) -> DataFrame:
    """dk, nt, n, bits, half and prefix of each class: its first tokens by rarity; of its n tokens the parities of their
    bits: 64, and from LONG tokens on half of 128, whose other half the 64 give."""
    ranks = rarities(classes)
    hashes = F.array_distinct(F.transform(words("line"), lambda w: F.xxhash64(w)))
    # No entry is null, and Spark sorts longs that cannot be null as plain numbers.
    ordered = F.transform(hashes, lambda h: F.coalesce(ranks[h.bitwiseAND(F.lit(BUCKETS - 1))], F.lit(0).cast("long")).bitwiseOR(h.bitwiseAND(F.lit((1 << LOW) - 1))))
    lines = classes.select("dk", packed(), F.sort_array(ordered).alias("t")).withColumn("n", F.size("t"))
    parity = F.expr("aggregate(t, 0L, (all, x) -> all ^ shiftleft(1L, cast(x & 63L as int)))").alias("bits")
    half = F.expr("aggregate(filter(t, x -> x & 64L = 0L), 0L, (all, x) -> all ^ shiftleft(1L, cast(x & 63L as int)))")
    prefix = F.slice("t", 1, F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("int") + 1).alias("prefix")
    return lines.select("dk", "nt", "n", parity, F.when(F.col("n") >= LONG, half).alias("half"), prefix)


def dealt(prefixes: DataFrame) -> DataFrame:
    """p and POST for each token of each prefix; p: 32 bits of the token's hash, where lines meet."""
    # Outer, as no filter on the prefix is to be made of the explode; p is never null, so joins make no filter of it.
    tokens = prefixes.select("dk", "nt", "n", "done", "bits", "half", F.posexplode_outer("prefix").alias("i", "token"))
    at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).bitwiseOR(F.col("done")).alias("at")
    p = F.coalesce(F.shiftright(F.shiftleft("token", 16), 32).cast("int"), F.lit(0)).alias("p")
    return tokens.select(p, "dk", "nt", at, "bits", "half")


def posts_of(classes: DataFrame) -> DataFrame:
    """p and POST for each prefix token of each class."""
    return dealt(prefixes_of(classes).withColumn("done", F.lit(0).cast("long")))


def before(a: str, b: str = "") -> Column:
    """The line with columns named a_ is earlier than the one with columns named b."""
    return (F.col(f"{a}dk") < F.col(f"{b}dk")) | ((F.col(f"{a}dk") == F.col(f"{b}dk")) & (F.shiftright(f"{a}nt", 32) < F.shiftright(f"{b}nt", 32)))


def size_of(a: str) -> Column:
    """How many tokens the line of a post has."""
    return F.shiftright(f"{a}at", 32)


def index_of(a: str) -> Column:
    """How many tokens are before that of a post."""
    return F.shiftright(F.col(f"{a}at").bitwiseAND(F.lit((1 << 32) - 1)), 1)


def may_be_similar(a: str, b: str = "") -> Column:
    """The filters for two lines that meet at a token with i tokens of n before it; a, b: prefixes of names.

    Similar lines of m and n tokens share PERCENT / (100 + PERCENT) of m + n at least. They also meet at the first token
    that they share, and there as many must be from it on in both; that holds only for lines that fit in length, and
    spares most of the later places where the same two meet. The rest bounds the tokens that one line has alone, and
    with them the bits that differ.
    """
    both = size_of(a) + size_of(b)
    places = F.least(size_of(a) - index_of(a), size_of(b) - index_of(b)) * (100 + PERCENT) >= both * PERCENT
    bits, half = (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in ("bits", "half"))
    turned = F.coalesce(F.bit_count(half) + F.bit_count(half.bitwiseXOR(bits)), F.bit_count(bits))
    return places & (turned * (100 + PERCENT) <= both * (100 - PERCENT))


def key_of(a: str = "") -> list[Column]:
    """KEY from dk and nt, with the same prefix of names."""
    no, th = F.shiftright(f"{a}nt", 32), F.shiftright(F.shiftleft(f"{a}nt", 32), 32)
    return [F.col(f"{a}dk"), no.cast("int").alias(f"{a}no"), th.cast("int").alias(f"{a}th")]


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """dk, no, th of the later lines of pairs (x_dk, x_no, x_th, dk, no, th) whose sets of words are similar."""
    pairs = written(pairs.select(*(f"x_{c}" for c in KEY), *KEY).distinct(), "pairs")
    wanted = pairs.select(*KEY).union(pairs.select(*(f"x_{c}" for c in KEY))).distinct()
    # Few lines are looked up in one pass over all; many are dealt by key.
    wanted = F.broadcast(wanted) if 2 * pairs.count() <= LOOKED_UP else wanted
    sets = written(classes.join(wanted, list(KEY), "left_semi").select(*KEY, F.array_distinct(words("line")).alias("t")), "sets", dictionary=False)
    both = pairs.join(sets, list(KEY)).join(sets.select(*(F.col(c).alias(f"x_{c}") for c in KEY), F.col("t").alias("s")), [f"x_{c}" for c in KEY])
    similar = F.size(F.array_intersect("s", "t")) * (100 + PERCENT) >= (F.size("s") + F.size("t")) * PERCENT
    out = written(both.filter(similar).select(*KEY).distinct(), "settled")
    for done in (pairs, sets):
        discard(done)
    return out


def duplicate_lines(docs: DataFrame, repeat: bool = True) -> DataFrame:
    """dk, th, no of every line that an earlier one makes go; near: no earlier line has just its words."""
    rows = rows_of(docs, repeat)
    lines = written(lines_of(rows.dropDuplicates(["dk", "th"]) if repeat else rows), "lines", dictionary=False)
    # Of equal lines the first; each is looked up by the hashes of its words.
    firsts = lines.groupBy("a", "b").agg(F.min(F.struct(*KEY)).alias("f"), F.count(F.lit(1)).alias("lines")).filter("lines > 1")
    firsts = written(firsts.select("a", "b", *(F.col(f"f.{c}").alias(f"f_{c}") for c in KEY)), "firsts")
    few = firsts.count() <= LOOKED_UP
    looked_up = F.broadcast(firsts) if few else firsts
    first = (F.col("f_dk") == F.col("dk")) & (F.col("f_no") == F.col("no")) & (F.col("f_th") == F.col("th"))
    classes = lines.join(looked_up, ["a", "b"], "left").filter(F.col("f_dk").isNull() | first).select(*KEY, "line")
    classes = classes if few else written(classes, "classes", dictionary=False)

    prefixes = written(prefixes_of(classes), "prefixes", dictionary=False)
    size = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    partitions = int(min(PARTITIONS, max(LEAST, size // PARTITION)))
    every = dealt(prefixes.withColumn("done", F.lit(0).cast("long"))).repartition(partitions, "p")
    order = Window.partitionBy("p").orderBy("dk", "nt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = every.select("p", *POST, F.first(F.struct(*POST)).over(order).alias("x")).select(*POST, *(F.col(f"x.{c}").alias(f"x_{c}") for c in POST))
    settled = verified(heads.filter(before("x_") & may_be_similar("x_")).select(*key_of("x_"), *key_of()), lines)

    # Few settled lines go to every task.
    done = settled.select("dk", packed(), F.lit(1).cast("long").alias("done"))
    done = F.broadcast(done) if settled.count() <= LOOKED_UP else done
    posts = dealt(prefixes.join(done, ["dk", "nt"], "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))).repartition(partitions, "p")
    # Of two similar lines the shorter has the first token that they share in a shorter prefix. Both sides read one exchange:
    # a filter with rand(), which is too small to matter beside whole numbers, is not moved to before it.
    short = index_of("") * (100 + PERCENT) - F.rand(0) <= size_of("") * (100 - PERCENT)
    others = posts.filter(short).select("p", *(F.col(c).alias(f"x_{c}") for c in POST))
    is_open = lambda a: F.col(f"{a}at").bitwiseAND(F.lit(1)) == 0
    later_is_open = F.when(before("x_"), is_open("")).when(before("", "x_") & (size_of("") > size_of("x_")), is_open("x_")).otherwise(F.lit(False))
    met = posts.join(others, "p").filter((size_of("") >= size_of("x_")) & later_is_open & may_be_similar("x_"))
    met = met.select(before("x_").alias("turn"), *key_of("x_"), *key_of())
    met = met.select(*(F.when(F.col("turn"), F.col(f"x_{c}")).otherwise(F.col(c)).alias(f"x_{c}") for c in KEY), *(F.when(F.col("turn"), F.col(c)).otherwise(F.col(f"x_{c}")).alias(c) for c in KEY))
    later = verified(met, lines)

    # A copy of a line goes by the earliest of its equals; that one only if it is near an earlier line.
    near = written(settled.unionByName(later).distinct(), "near")
    copies = lines.select("a", "b", *KEY).join(looked_up, ["a", "b"]).filter(~first)
    earlier = (F.col("f_dk") < F.col("dk")) | (F.col("f_no") < F.col("no"))
    gone = copies.filter(earlier).select("dk", "th", "no", F.lit(False).alias("near")).unionByName(near.select("dk", "th", "no", F.lit(True).alias("near")))
    if repeat:  # lines at the place of the first, of rows with its doc_id, go with it
        beside = copies.filter(~earlier).join(near.select(*(F.col(c).alias(f"f_{c}") for c in KEY)), [f"f_{c}" for c in KEY])
        gone = gone.unionByName(beside.select("dk", "th", "no", F.lit(True).alias("near")))
    out = written(gone, "gone")
    for done in (lines, firsts, prefixes, settled, later, near, *(() if few else (classes,))):
        discard(done)
    return out


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near (lines that go), kept_sha256 of the lines that stay, joined as they were."""
    repeat = ids_repeat(docs)
    gone = duplicate_lines(docs, repeat)
    by_row = gone.groupBy("dk", "th").agg(F.collect_set("no").alias("gone"), F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"))  # lines of one text
    # Few numbers of lines go to every task; else texts and numbers are dealt by row.
    by_row = F.broadcast(by_row) if gone.count() <= 2 * LOOKED_UP else by_row.hint("shuffle_hash")
    both = rows_of(docs, repeat).join(by_row, ["dk", "th"], "left")
    lines = F.split("text", "\n")
    stay = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    none = F.lit(0)
    return both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_equal", none).cast("long").alias("n_equal"), F.coalesce("n_near", none).cast("long").alias("n_near"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
