"""Spelling variants by anagram hashing: words one letter apart, found through integer keys.

A word's key is the sum of its letters' fifth powers, so anagrams share it whatever their
letter order, and a word that differs by one letter added, removed or exchanged has a key
that differs by that letter's value or by the difference of two.  Every word puts out its
own key and, for each letter it has, the key less that letter; two words meet where such
keys are equal, and the letter order is verified on the words that meet.

Results for odd input: a null or empty text has no words; a run of letters of any length
is read whole; texts and rows that repeat count each time; an empty table gives an empty
result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.workspace import materialise

# Fixed by the contract: the letters of a word, the rate of damage, the sizes that count.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
DAMAGE = 31
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Letters count from here, so that values stay small; keys are sums modulo 2**62.
BASE = 96
MASK = (1 << 62) - 1


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(word: Column, at: Column) -> Column:
    """The word less its code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: every occurrence of a word of 7 letters or more, some with a letter deleted.

    Deletion shortens a run, so shorter runs are never read.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), ascii_lower(F.col("run")))).alias("h"))
    cut = without(F.col("run"), F.pmod("h", F.length("run")).cast("int"))
    return runs.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= MIN_LENGTH)


def counted(words: DataFrame) -> DataFrame:
    """word, n of the words that occur often enough; summed before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def letter_value(letter: Column) -> Column:
    code = (F.ascii(letter) - BASE).cast("long")
    return code * code * code * code * code


def anagram_key(letters: Column) -> Column:
    """The sum of an array of letters' values."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda key, x: (key + letter_value(x)).bitwiseAND(F.lit(MASK)))


def count_of(letter: Column, word: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, letter, F.lit("")))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: the words one inserted, deleted or replaced letter apart, both ways round.

    The join's keys are (anagram key, length): of the words that meet there, each lacks
    one letter or, being a letter shorter, none.  A pair of words meets at one key only,
    as the letter taken from each is one that it has more of than the other.
    """
    letters = F.array_distinct(F.split("word", ""))
    keyed = vocabulary.select("word", "n", anagram_key(F.split("word", "")).alias("key"), F.length("word").alias("len"), letters.alias("letters"))
    keyed = materialise(keyed, "keys")
    taken = keyed.select("word", "n", F.explode("letters").alias("letter"), "key", (F.col("len") - 1).alias("len"))
    taken = taken.withColumn("key", (F.col("key") - letter_value(F.col("letter"))).bitwiseAND(F.lit(MASK)))
    left = taken.select("key", "len", "word", "n", "letter")
    other = taken.select("key", "len", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letter").alias("other"))
    surplus = count_of(F.col("letter"), F.col("word")) == count_of(F.col("letter"), F.col("near")) + 1
    verified = F.levenshtein("word", "near", 1) == 1
    exchanged = left.join(other, ["key", "len"]).filter((F.col("letter") != F.col("other")) & surplus & (count_of(F.col("other"), F.col("near")) == count_of(F.col("other"), F.col("word")) + 1) & verified)
    whole = keyed.select("key", "len", F.col("word").alias("near"), F.col("n").alias("near_n"))
    removed = materialise(left.join(whole, ["key", "len"]).filter(surplus & verified).select("word", "n", "near", "near_n"), "removed")
    added = removed.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return exchanged.select("word", "n", "near", "near_n").union(removed).union(added)


def best_forms(vocabulary: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word, where frequent enough."""
    best = pairs.groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    found = vocabulary.join(best, F.col("word") == F.col("of"), "left")
    known = -F.col("best.minus") >= RATIO * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best.form")).alias("form"), F.when(known, -F.col("best.minus")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root: the last form reached.  A form is ten times as frequent, so chains are short,
    and every round doubles the steps taken; few words have a form, and only those move on."""
    steps = materialise(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = materialise(steps.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", replaces=steps)
        steps = moved
        if steps.filter("moved").isEmpty():
            break
    roots = steps.select(F.col("word").alias("of"), "root")
    return forms.join(roots, F.col("word") == F.col("of"), "left").withColumn("root", F.coalesce("root", "word")).drop("of")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text)."""
    vocabulary = materialise(counted(damaged_words(docs)), "vocabulary")
    forms = materialise(best_forms(vocabulary, near_pairs(vocabulary)), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
