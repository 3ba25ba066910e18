"""Names in texts: which names occur in which texts, as substrings, without a nested loop and without a bound on names.

Words are what single spaces separate. A name of several words occurs where its first word ends a word of the
text, its last begins one and those between are whole words; a name of one word occurs inside a word. So each
name is anchored at its longest inner word, or else its longest word, and only the different words of all texts
are searched for anchors: a whole word by an equi-join, a part of a word by the anchor's rarest GRAM letters. The
texts then meet the words that were found, and names of several words are verified with contains().

Equal names are sought once, however many ids they have; the ids come last, in lists of about LIST.

Null names and texts, and names without a letter other than spaces, match nothing; names under `least` letters are left out. Rows that share an id are
one text or one name for the result, which has each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.lineage import cut, stored

GRAM, LIST = 3, 1000
#: Pairs of a word and a name that may be broadcast to the texts; more are joined by shuffle.
LOOKED_UP = 500_000


def anchored(names: DataFrame) -> DataFrame:
    """name, anchor, whole of different names: the word to look for, and if it is a whole word of the text."""
    words = F.split("name", " ", -1)
    inner = F.when(F.size("words") > 2, F.slice("words", 2, F.size("words") - 2)).otherwise(F.array().cast("array<string>"))
    longest = lambda c: F.array_max(F.transform(c, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = names.withColumn("words", words).withColumn("inner", longest(inner)).withColumn("part", longest(F.col("words")))
    # A whole word of two letters or fewer says little; the longest word of the name then serves as part of a word.
    whole = F.length("inner") >= F.least(F.length("part"), F.lit(GRAM))
    return rows.select("name", F.coalesce(whole, F.lit(False)).alias("whole"), F.when(whole, F.col("inner")).otherwise(F.col("part")).alias("anchor"))


def grams(word: Column, size: int) -> Column:
    """The different runs of `size` letters of a word, in time proportional to its length; a shorter word has none."""
    letters = F.split(word, "")
    n = F.char_length(word)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat(*(F.get(letters, i + k) for k in range(size))))))


def inside(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """anchor, word: the words of the vocabulary that an anchor is part of."""
    anchors = parts.select("anchor").distinct()
    size = F.least(F.char_length("anchor"), F.lit(GRAM))
    of_anchor = anchors.withColumn("gram", F.explode(F.when(size == GRAM, grams(F.col("anchor"), GRAM)).otherwise(F.array("anchor"))))
    sought = cut(of_anchor.select("gram").distinct())
    sizes = [r["n"] for r in sought.select(F.char_length("gram").alias("n")).distinct().collect()] or [GRAM]  # GRAM rows at most
    # Only grams of anchors matter; their counts name each anchor's rarest one.
    gram = F.explode(F.flatten(F.array_compact(F.array(*(grams(F.col("word"), k) for k in sizes)))))
    few = F.broadcast(sought) if sought.count() <= LOOKED_UP else sought
    of_word = stored(vocabulary.select("word", gram.alias("gram")).join(few, "gram", "left_semi"))
    counts = of_word.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = of_anchor.join(counts, "gram").groupBy("anchor").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rarest.join(of_word, "gram").filter(F.contains("word", "anchor")).select("anchor", "word")


def with_ids(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """text_id, name_id for pairs of text_id and name; a name with very many ids is dealt by lists of them."""
    counts = names.groupBy("name").agg((F.count(F.lit(1)) / LIST + 1).cast("int").alias("lists"))
    lists = names.join(counts, "name").withColumn("list", F.pmod(F.xxhash64("name_id"), "lists")).groupBy("name", "list").agg(F.collect_list("name_id").alias("ids"))
    each = pairs.join(counts, "name").select("text_id", "name", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("lists") - 1).cast("long"))).alias("list"))
    return each.join(lists, ["name", "list"]).select("text_id", F.explode("ids").alias("name_id"))


def mentions(texts: DataFrame, names: DataFrame, least: int = 4, looked_up: int = LOOKED_UP) -> DataFrame:
    """text_id, name_id of every name in every text; texts has text_id, text and names name_id, name."""
    words = F.array_distinct(F.split("text", " ", -1))
    known = cut(names.select("name_id", "name").filter(F.length("name") >= least).distinct())
    named = cut(anchored(known.select("name").distinct()).filter("anchor != ''"))
    vocabulary = stored(texts.select(F.explode(words).alias("word")).filter("word != ''").distinct())
    exact = named.filter("whole").join(vocabulary.withColumnRenamed("word", "anchor"), "anchor").withColumn("word", F.col("anchor"))
    part = named.filter("NOT whole")
    partly = part.join(inside(part, vocabulary), "anchor")
    # One word says all of a name of one word; the others are verified where the text is. Of these the first word ends
    # a word and the last begins one.
    plain = ~F.contains("name", F.lit(" "))
    ends, begins = F.startswith("name", F.concat("anchor", F.lit(" "))) & F.endswith("word", "anchor"), F.endswith("name", F.concat(F.lit(" "), "anchor")) & F.startswith("word", "anchor")
    partly = partly.filter(plain | ends | begins)
    found = cut(exact.select("word", "name", plain.alias("plain")).unionByName(partly.select("word", "name", plain.alias("plain"))))
    sizes = {r["plain"]: r["count"] for r in found.groupBy("plain").count().collect()}
    if sum(sizes.values()) <= looked_up:
        met = texts.select("text_id", "text", F.explode(words).alias("word")).join(F.broadcast(found), "word")
        pairs = met.filter(F.col("plain") | F.contains("text", "name")).select("text_id", "name").distinct()
    else:
        few = {k: n <= looked_up for k, n in sizes.items()}
        of = lambda k: F.broadcast(found.filter(F.col("plain") == k).drop("plain")) if few.get(k) else found.filter(F.col("plain") == k).drop("plain")
        sure = texts.select("text_id", F.explode(words).alias("word")).join(of(True), "word").select("text_id", "name")
        if few.get(False):
            likely = texts.select("text_id", "text", F.explode(words).alias("word")).join(of(False), "word")
        else:
            likely = texts.select("text_id", F.explode(words).alias("word")).join(of(False), "word").select("text_id", "name").distinct().join(texts, "text_id")
        pairs = sure.unionByName(likely.filter(F.contains("text", "name")).select("text_id", "name")).distinct()
    out = with_ids(pairs, known)
    renamed = known.groupBy("name_id").count().filter("count > 1")
    return out if renamed.isEmpty() else out.distinct()
