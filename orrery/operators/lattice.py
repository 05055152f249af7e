"""Lattices: sets as arrays or long tables, growable and fixed bit sets, ordered vectors, truth values.

Sets are sorted arrays without repeats; bit sets hold the places of their ones, fixed ones beside their universe's
size n, growable ones as struct(bits, len). A null operand gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def meet_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def compare_sets(a: Column, b: Column) -> Column:
    """-1, 0, 1, or null if neither holds the other."""
    below, above = is_subset(a, b), is_subset(b, a)
    return F.when(below & above, 0).when(below, -1).when(above, 1)


def join_vectors(a: Column, b: Column) -> Column:
    """a as it is, its repeats too, then what b adds in b's order."""
    return F.concat(a, F.array_except(b, a))


def meet_vectors(a: Column, b: Column) -> Column:
    return F.array_distinct(F.filter(a, lambda x: F.array_contains(b, x)))


def bit_sets(rows: DataFrame, key: str, bit: str) -> DataFrame:
    """(key, bits): distinct bits in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(bit)).alias("bits"))


def complement(bits: Column, n: Column) -> Column:
    """Of a fixed bit set in {0 .. n - 1}."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), bits)).otherwise(F.array().cast("array<bigint>"))


def with_element(a: Column, x: Column) -> Column:
    return join_sets(a, F.array(x))


def without_element(a: Column, x: Column) -> Column:
    return F.array_sort(F.array_remove(a, x))


def bottom_of(kind: str = "bigint") -> Column:
    """The empty set."""
    return F.array().cast(f"array<{kind}>")


def top_of(n: Column) -> Column:
    """All of a universe of n places."""
    return complement(bottom_of(), n)


def bit_at(bits: Column, n: Column, i: Column) -> Column:
    """Whether place i is one; null outside the universe."""
    return F.when((i >= 0) & (i < n), F.array_contains(bits, i))


def set_bit(bits: Column, n: Column, i: Column, value: Column) -> Column:
    """The bit set with place i as given; null outside the universe."""
    return F.when((i >= 0) & (i < n), F.when(value, with_element(bits, i)).otherwise(without_element(bits, i)))


def join_growable(a: Column, b: Column) -> Column:
    """The shorter is padded with zeros."""
    return F.struct(join_sets(a["bits"], b["bits"]).alias("bits"), F.greatest(a["len"], b["len"]).alias("len"))


def meet_growable(a: Column, b: Column) -> Column:
    """The shorter is padded with zeros, so the longer's length stays."""
    return F.struct(meet_sets(a["bits"], b["bits"]).alias("bits"), F.greatest(a["len"], b["len"]).alias("len"))


def set_growable(a: Column, i: Column, value: Column) -> Column:
    """Place i as given; a place behind the end lets the vector grow to it."""
    bits = F.when(value, with_element(a["bits"], i)).otherwise(without_element(a["bits"], i))
    return F.struct(bits.alias("bits"), F.greatest(a["len"], i + 1).alias("len"))


def compare_growable(a: Column, b: Column) -> Column:
    """-1, 0, 1, or null if neither holds the other or the lengths differ."""
    return F.when(a["len"] == b["len"], compare_sets(a["bits"], b["bits"]))


def compare_vectors(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first difference; a prefix comes first."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def join_truth(a: Column, b: Column) -> Column:
    return a | b


def meet_truth(a: Column, b: Column) -> Column:
    return a & b


def compare_truth(a: Column, b: Column) -> Column:
    """False lies below true."""
    return a.cast("int") - b.cast("int")


def meet_all(rows: DataFrame, key: str, group: str, element: str) -> DataFrame:
    """(key, element): elements that all groups of a key hold. Counts, so no set is gathered."""
    sets = rows.select(key, group, element).distinct()
    total = sets.groupBy(key).agg(F.count_distinct(group).alias("groups"))
    held = sets.groupBy(key, element).agg(F.count("*").alias("n"))
    return held.join(total, key).filter("n = groups").select(key, element)


def join_all(rows: DataFrame, key: str, element: str) -> DataFrame:
    """(key, element): elements that some group of a key holds."""
    return rows.select(key, element).distinct()


# Packed sets: arrays of 64-bit words, bit i of a set in word i / 64. A shorter array stands for zeros behind its end.


def _shifted(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def _one(at: Column) -> Column:
    return _shifted("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))


def _padded(a: Column, b: Column, f) -> Column:
    zero = F.lit(0).cast("long")
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def words_for(n: int) -> int:
    """Words that hold n bits."""
    return (n + 63) // 64


def packed(rows: DataFrame, key: str, bit: str, n: int, name: str = "words") -> DataFrame:
    """(key, name): the set of each key's bits as words for n of them. Bits are or-ed into words before they are sent; null
    bits and those outside 0 .. n - 1 are left out, a key that has no others has the empty set."""
    inside = F.col(bit).between(0, n - 1)
    place = F.when(inside, F.col(bit)).cast("long")
    each = rows.select(key, F.floor(place / 64).alias("_word"), _one(place).alias("_bit")).groupBy(key, "_word").agg(F.bit_or("_bit").alias("_bits"))
    return _listed_words(each, key, words_for(n), name)


def _listed_words(each: DataFrame, key: str, size: int, name: str) -> DataFrame:
    found = F.map_from_entries(F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("_word", "_bits"))))
    at = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")) if size else F.array().cast("array<bigint>")
    return each.groupBy(key).agg(found.alias("_map")).select(key, F.transform(at, lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0).cast("long"))).alias(name))


def packed_rows(rows: DataFrame, key: str, bit: str, n: int, **sets: Column) -> DataFrame:
    """(key, word, *sets): sets of each key's bits side by side, word by word, as bit sets of wide universes mostly have empty
    words: a word that is empty in all sets has no row. Each set has the bits where its condition holds. What is in no set
    stands in one row a key, with a null word and empty sets, so that no key is missing."""
    place = F.when(F.col(bit).between(0, n - 1), F.col(bit)).cast("long")
    held = rows.select(key, place.alias("_place"), *[c.alias(name) for name, c in sets.items()])
    some = F.greatest(*[F.coalesce(F.col(name), F.lit(False)) for name in sets])
    each = held.select(key, F.when(some, F.floor(F.col("_place") / 64)).alias("word"), _one(F.col("_place")).alias("_bit"), *sets)
    return each.groupBy(key, "word").agg(*[F.coalesce(F.bit_or(F.when(F.col(name), F.col("_bit"))), F.lit(0).cast("long")).alias(name) for name in sets])


def places_in(words: Column) -> Column:
    """The bits, in order, of a set as an array of struct(word, bits)."""
    bits = F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))
    return F.flatten(F.transform(F.array_sort(words), lambda x: F.transform(F.filter(bits, lambda j: x["bits"].bitwiseAND(_one(j)) != 0), lambda j: x["word"] * 64 + j)))


def join_words(a: Column, b: Column) -> Column:
    return _padded(a, b, lambda x, y: x.bitwiseOR(y))


def meet_words(a: Column, b: Column) -> Column:
    return _padded(a, b, lambda x, y: x.bitwiseAND(y))


def minus_words(a: Column, b: Column) -> Column:
    return _padded(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def complement_words(a: Column, n: int) -> Column:
    """In {0 .. n - 1}: bits of the last word behind n stay zero."""
    last = (1 << n % 64) - 1 if n % 64 else -1
    return F.transform(a, lambda x, i: F.bitwise_not(x).bitwiseAND(F.when(i == words_for(n) - 1, F.lit(last).cast("long")).otherwise(F.lit(-1).cast("long"))))


def count_words(a: Column) -> Column:
    """Ones of the set."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def no_words(a: Column) -> Column:
    """Whether the set is empty."""
    return F.forall(a, lambda x: x == 0)


def words_below(a: Column, b: Column) -> Column:
    """Whether b holds all of a."""
    return no_words(minus_words(a, b))


def compare_words(a: Column, b: Column) -> Column:
    """-1, 0, 1, or null if neither holds the other."""
    below, above = words_below(a, b), words_below(b, a)
    return F.when(below & above, 0).when(below, -1).when(above, 1)


def word_bit(a: Column, i: Column) -> Column:
    """Whether bit i is one; false behind the end, null for negative places."""
    word = F.coalesce(F.get(a, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    return F.when(i >= 0, word.bitwiseAND(_one(i)) != 0)


def set_word_bit(a: Column, i: Column, value: Column) -> Column:
    """The set with bit i as given; words are added up to it, so growable vectors grow."""
    at = F.floor(i / 64).cast("int")
    long = F.concat(a, F.array_repeat(F.lit(0).cast("long"), F.greatest(at + 1 - F.size(a), F.lit(0))))
    return F.transform(long, lambda x, k: F.when(k != at, x).when(value, x.bitwiseOR(_one(i))).otherwise(x.bitwiseAND(F.bitwise_not(_one(i)))))


def places_of(a: Column) -> Column:
    """The set's bits in order."""
    bits = F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.filter(bits, lambda j: x.bitwiseAND(_one(j)) != 0), lambda j: i.cast("long") * 64 + j)))


def join_packed(rows: DataFrame, key: str, words: str, size: int) -> DataFrame:
    """(key, words): the union of each key's sets of `size` words, or-ed word by word before it is sent."""
    each = rows.select(key, F.posexplode(words).alias("_word", "_bits")).groupBy(key, F.col("_word").cast("long").alias("_word")).agg(F.bit_or("_bits").alias("_bits"))
    return _listed_words(each, key, size, words)


def meet_packed(rows: DataFrame, key: str, words: str, size: int) -> DataFrame:
    """(key, words): the intersection of each key's sets of `size` words."""
    each = rows.select(key, F.posexplode(words).alias("_word", "_bits")).groupBy(key, F.col("_word").cast("long").alias("_word")).agg(F.bit_and("_bits").alias("_bits"))
    return _listed_words(each, key, size, words)
